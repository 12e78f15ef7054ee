"""DataFrame -> DataFrame operators, keyed by document (and page)."""
