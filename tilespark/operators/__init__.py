"""Set-at-a-time operators on tiles, entries and requests."""
