"""Grammars and token rules of each language that code files are written in."""
