"""Operators on text corpora; nothing else in sondegrid imports this package."""
