"""Operators for preparing text corpora, and their registered queries."""
