"""Faceted record search, index building and index maintenance as Spark DataFrame plans."""
