"""Batch and streaming Spark jobs over corpora of source files and documents."""
