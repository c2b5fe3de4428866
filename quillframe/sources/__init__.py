"""Readers of delimited text, spreadsheets and stored tables."""
