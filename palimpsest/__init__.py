"""A Spark engine for versioned, ordered key-value data."""
