"""A relational analytics engine on PySpark: scans, operators and storage as DataFrames."""
