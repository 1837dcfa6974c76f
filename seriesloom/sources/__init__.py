"""Readers, file gates, column detection and writers."""
