"""loomwork: Spark-native analytics for data-warehouse code, tables and files."""
