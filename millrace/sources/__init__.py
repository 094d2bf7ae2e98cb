"""Readers and writers of JSON texts and tables."""
