"""tidemark: incremental commerce analytics as PySpark DataFrame functions."""
