"""The expression language."""
