"""Queries over the tables and the scan pipeline."""
