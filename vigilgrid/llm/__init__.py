"""Operators for preparing training data, one module each, and their registered queries."""
