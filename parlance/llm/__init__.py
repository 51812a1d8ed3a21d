"""Operators for large training corpora: one module per operator, each with its query."""
