"""Training-data operators over a table of documents."""
