"""Numerical kernels: one small numpy function per series window.

Spark packs each calendar-bounded window into one array row and spreads the
rows; a kernel turns one row into one row. Failures become a status, never an
exception, so one bad series cannot fail a job.
"""
