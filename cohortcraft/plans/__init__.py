"""Plans: the named queries, their oracle SQL and plan inspection helpers."""
