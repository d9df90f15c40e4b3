"""Whole jobs: serving requests, converting tile sets, building pyramids."""
