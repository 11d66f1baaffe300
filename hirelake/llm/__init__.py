"""Operators of a training-data pipeline.

Every module holds one operator with an interface of its own; ``queries`` registers one query per
operator, with production parameters over whole tables. Nothing outside this package imports it.
"""
