"""Whole-table state machine and the query registry."""
