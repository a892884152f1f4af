"""A PySpark-native batch analytics engine: text metrics, inverted indexes, averages, joins and delta chains."""
