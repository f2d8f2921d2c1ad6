"""Column-expression builders (pure Spark built-ins, no UDFs)."""
