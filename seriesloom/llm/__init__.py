"""Operators for preparing text collections, and the queries that apply them to whole tables."""
