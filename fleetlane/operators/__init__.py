"""DataFrame -> DataFrame operators (no collect, no Python UDFs)."""
