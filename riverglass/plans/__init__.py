"""Registered queries, one per operator, each with a SQL twin where SQL can express it."""
