"""Bilateral trade analytics as Spark DataFrame plans."""
