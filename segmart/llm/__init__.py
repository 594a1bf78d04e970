"""Operators for language-model training data: one module for each, and their registered queries."""
