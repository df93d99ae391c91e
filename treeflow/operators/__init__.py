"""Operators on flows and nodes: choice models, lookups, encodings, tables."""
