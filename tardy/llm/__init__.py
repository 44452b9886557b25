"""Operators for preparing language-model training data.

Nothing else in the library imports this package; it uses the library's
general helpers (written stage tables, the shared checkpoint folder).
"""
