"""Queries over the star schema projected to a property graph."""
