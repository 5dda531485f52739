"""Set-based analytics for content pipelines on Spark."""
