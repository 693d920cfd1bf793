"""Named queries and oracle SQL."""
