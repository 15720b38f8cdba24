"""Scores of response streams."""
