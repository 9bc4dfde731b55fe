"""Readers, writers, reference tables and table bindings."""
