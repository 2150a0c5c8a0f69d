"""The registered point-cloud queries and their SQL."""
