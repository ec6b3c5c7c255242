"""tidemill: a PySpark-native engine for iterative graph analytics, block linear algebra and corpus work."""
