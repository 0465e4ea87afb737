"""bidlens: procurement-notice analytics as Spark DataFrame and Structured Streaming jobs."""
