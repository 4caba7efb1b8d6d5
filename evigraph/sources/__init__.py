"""Readers, writers and the mapping of tables to the graph domain."""
