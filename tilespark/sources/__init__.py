"""Readers and writers: archives, tile databases, tile trees, request and cutline files."""
