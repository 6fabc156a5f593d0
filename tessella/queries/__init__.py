"""The queries of the registry, with their SQL."""
