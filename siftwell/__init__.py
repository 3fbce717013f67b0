"""Retrieval and usage analytics expressed as Spark DataFrame operators."""
