"""Relational building blocks: numbering, key assignment, lookups, checks."""
