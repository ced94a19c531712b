"""Relational operators of the engine: ingest, index, search and factorisation."""
