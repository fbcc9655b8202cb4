"""Lodestone: record linkage and corpus preparation as Spark DataFrame transformations."""
