from korrel.streaming.spill import scan, write, write_partitioned

__all__ = ["scan", "write", "write_partitioned"]
