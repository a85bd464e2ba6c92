"""Compositions: endpoint bundles, export tables, ingest gate, query registry, oracle SQL."""
