"""Compositions: extraction of areas, habitat stages, merging of plans, documents."""
