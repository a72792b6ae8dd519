"""Whole-store plans and the query catalogue."""
