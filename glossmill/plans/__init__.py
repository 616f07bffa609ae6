"""Whole programs, and the catalogue of queries."""
