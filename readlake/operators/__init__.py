"""DataFrame operators on read tables."""
