"""Plans: learning, tuning and the registered query catalog."""
