"""Spark operators over collections of annotated DNA constructs."""
