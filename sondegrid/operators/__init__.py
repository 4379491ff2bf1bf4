"""Operators: lazy DataFrame to DataFrame functions."""
