"""Operators for preparing training text: fingerprints, packing, language, quality, safety, duplicates."""
