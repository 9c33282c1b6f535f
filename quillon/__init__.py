"""Prose analytics as DataFrame operators: text in, hits, features and corpus statistics out."""

__version__ = "0.1.0"
