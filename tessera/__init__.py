"""Spark-native analytics for synthetic spatial counts: simulation, neighbourhoods, clustering, scoring, diagnosis."""
