"""Lineora: SQL lineage and query-structure analytics on PySpark."""
