"""Part of sondegrid."""
