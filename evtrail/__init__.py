"""evtrail."""
