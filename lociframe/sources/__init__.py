"""Readers and writers for sequence, alignment, range and transcript files."""
