"""Spark-native construction and scoring of question-answering benchmarks."""
