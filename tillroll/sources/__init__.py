"""Readers and writers: driver tables, stored sales table, CSV, sinks, cache, catalog."""
