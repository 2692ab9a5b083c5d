"""The query catalogue: one plan per analytic, with its oracle SQL where SQL can express it."""
