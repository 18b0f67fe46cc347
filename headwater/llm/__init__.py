"""Operators on free text: matching, deduplication, splitting, packing, mixing and classifying."""
