"""Operators for large text collections: filters, near-duplicates, repeats, counts, mixing and records for chat."""
