"""Vergence: evidence retrieval and commerce-data analytics as Spark DataFrame programs."""
