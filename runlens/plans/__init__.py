"""Registered queries (name -> plan) and their DuckDB oracles."""
