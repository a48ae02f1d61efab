"""A Spark-native analytics engine for nearest-neighbour scoring of transactions."""
