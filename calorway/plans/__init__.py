"""Composed jobs: the city build and the city derived from the benchmark tables."""
