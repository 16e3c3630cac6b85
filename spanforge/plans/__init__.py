"""Registered queries over the derived relations, each beside its DuckDB oracle."""
