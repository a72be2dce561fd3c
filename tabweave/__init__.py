"""Tabular profiling, synthesis and synthetic-data scoring as Spark DataFrame operators."""
