"""Relational operators: interval algebra, overlap joins, windows, graphs."""
