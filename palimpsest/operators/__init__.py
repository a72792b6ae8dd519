"""Relational operators over mutations, runs and commands."""
