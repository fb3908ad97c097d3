"""Whole analyses, and the queries registered for verification."""
