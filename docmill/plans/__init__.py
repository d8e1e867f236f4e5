"""Compiled query plans and the query catalogue."""
