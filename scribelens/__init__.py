"""A Spark-native engine for auditing transcript benchmarks and preparing training text."""
