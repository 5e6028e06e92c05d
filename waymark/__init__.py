"""Waymark: geospatial, graph, search and event analytics as PySpark DataFrame operators."""
