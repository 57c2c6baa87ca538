"""Readers and writers of bars and outcomes."""
