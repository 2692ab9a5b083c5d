"""Files that arrive over time."""
