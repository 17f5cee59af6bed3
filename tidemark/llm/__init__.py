"""Operators for preparing training text: cleaning, deduplication, scoring, mixing and packaging."""
