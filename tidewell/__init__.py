"""tidewell: a Spark-first engine for text, link-graph and key-value analytics."""
