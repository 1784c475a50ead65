"""Scoring transforms on streams."""
