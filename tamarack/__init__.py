"""A PySpark-native analytics engine for text archives: ingest, search, grounded answers, and text rules as DataFrames."""
