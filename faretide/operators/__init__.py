"""DataFrame -> DataFrame operators on observations, items, runs and alerts."""
