"""Reproducible data generation: columns, keys between tables, series, and graphs, all from stateless hashes of row numbers."""
