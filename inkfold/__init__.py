"""Spark-native engine for reading, grading and auditing answer sheets."""
