"""Quote snapshots as Structured Streaming, sharing the batch functions."""
