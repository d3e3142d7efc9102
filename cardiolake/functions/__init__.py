"""Signal functions and pure state steps, applied by Spark to columns or groups."""
