"""Schemas, scans and the fixture views."""
