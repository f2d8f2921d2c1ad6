"""Training-data operators over the corpus tables.

Nothing outside this package imports it. Each operator module has a general
``DataFrame -> DataFrame`` interface; ``queries.py`` holds the thin
``opN_<name>`` registrations and their DuckDB statements.
"""
