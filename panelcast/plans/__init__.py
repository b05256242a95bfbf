"""Plans: the reference pipeline end to end, runs and suites, registered queries and their oracle SQL."""
