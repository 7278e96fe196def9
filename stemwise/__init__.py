"""A PySpark-native engine for auditing multiple-choice question benchmarks."""
