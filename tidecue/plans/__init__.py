"""Composite pipelines, registered queries and their SQL oracles."""
