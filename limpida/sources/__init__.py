"""Readers and writers of message tables."""
