"""Relational, as-of, window and statistical operators over the domain views."""
