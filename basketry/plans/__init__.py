"""Operators composed into queries over the star-schema tables, with SQL counterparts."""
