"""Spark-first analytics over versioned product catalogues."""
