"""Scoring of patient files as they arrive."""
