"""Types of the dialect: literals, coercion and rendering."""
