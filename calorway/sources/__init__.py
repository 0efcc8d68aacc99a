"""Readers and writers for landed open-data files and city tables."""
