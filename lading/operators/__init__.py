"""Relational operators over the tables of archives."""
