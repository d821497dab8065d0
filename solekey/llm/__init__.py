"""Operators for preparing training data: cleaning, filtering, near duplicates, packing."""
