"""Scoring with models made elsewhere."""
