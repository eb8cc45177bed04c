"""Spark-first engine for graph-pattern queries over quads and mapped tables."""
