"""Operators for preparing large text corpora: ranking, normalising, splitting, packing, filtering."""
