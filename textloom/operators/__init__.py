"""Relational operators over the tables of a text-analytics model."""
