"""quillgrove: a PySpark-native engine for retrieval over document collections."""
