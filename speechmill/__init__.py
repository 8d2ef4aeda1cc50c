"""PySpark-native analytics for spoken-language corpora."""
