"""Spark jobs over company, job, contact and application tables.

``sources``   schemas, scans, fixture views
``functions`` column expressions shared by the jobs
``operators`` one module per table job (filtering, resolution, reporting, ...)
``plans``     the whole-table state-machine advance and the registered queries
``streaming`` Structured Streaming twins of the event-driven reports
"""
