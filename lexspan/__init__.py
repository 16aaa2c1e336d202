"""Spark-native contract analytics: sections, references, entities, graphs and retrieval as DataFrames."""
