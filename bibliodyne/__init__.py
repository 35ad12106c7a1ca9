"""Spark-first analytics over large scholarly-literature collections."""
