"""Operators for preparing training data: search, dedup, classification, mixing, packing and extraction."""
