"""Spark-native colour analytics: pixels as a relation, palettes as queries."""
