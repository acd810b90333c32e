"""Retrieval and context analytics expressed as Spark DataFrame transformations."""
