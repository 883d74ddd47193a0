"""Lodestone: a PySpark-native engine for sorting, text, graph, geometry and vector problems."""
