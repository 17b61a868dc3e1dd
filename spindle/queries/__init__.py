"""The registered queries with their oracle SQL."""
