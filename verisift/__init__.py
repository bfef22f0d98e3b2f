"""Spark-native data quality, profiling and table loading.

Everything here takes and returns Spark DataFrames.  See README.md for a tour.
"""
