from korrel.sources.csv import csv_scan
from korrel.sources.heap import HeapFile
from korrel.sources.index import Index
from korrel.sources.memory import memory_scan
from korrel.sources.parquet import parquet_scan

__all__ = ["HeapFile", "Index", "csv_scan", "memory_scan", "parquet_scan"]
