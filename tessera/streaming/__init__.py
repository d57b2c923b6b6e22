"""What runs on a schedule beside the statements."""
