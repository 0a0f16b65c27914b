"""Scoring of newly arriving entities."""
