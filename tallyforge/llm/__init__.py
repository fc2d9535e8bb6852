"""Corpus preparation operators: archives, fingerprints, quality, formatting, tokens, mixing and URL filters."""
