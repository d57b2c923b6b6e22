"""An analytics engine on Spark: a small SQL dialect, a transactional table store and their operators."""
