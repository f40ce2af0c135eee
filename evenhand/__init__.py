"""Grouped-evaluation analytics on Spark: DataFrame in, DataFrame out."""
