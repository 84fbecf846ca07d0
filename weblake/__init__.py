"""Access-log lake: batch and streaming Spark jobs from raw web logs to a star schema."""
