"""tidewater: Spark-first data operators."""
