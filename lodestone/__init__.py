"""Spark-first engine for text retrieval, knowledge graphs and answer evaluation."""
