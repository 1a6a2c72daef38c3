"""Operators on tables of items, events, entities and scores."""
