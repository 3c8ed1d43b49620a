"""Spark-native analytics for water-level, altimeter, cell-table and catalogue records."""
