"""Operators over timelines."""
