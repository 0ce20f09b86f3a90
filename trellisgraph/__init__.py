"""Property-graph analytics over knowledge bases, written as PySpark plans."""
