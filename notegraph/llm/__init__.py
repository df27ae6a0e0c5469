"""Operators on text collections: near-duplicates, term statistics, co-occurrence, tokenizing, mixing, reading level."""
