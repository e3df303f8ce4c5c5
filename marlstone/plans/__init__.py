"""Schemas, the catalog, and running queries."""
