"""PySpark-native analytics for retail promotions."""
