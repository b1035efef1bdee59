"""Derived tables, named queries and the SQL surface."""
