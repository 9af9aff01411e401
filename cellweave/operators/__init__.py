"""Relational operators over cell tables, vectors and graphs."""
