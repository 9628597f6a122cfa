"""Named queries and their SQL."""
