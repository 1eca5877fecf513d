"""Named queries that bind operators to tables."""
