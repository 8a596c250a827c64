"""Training-data operators for very large document collections."""
