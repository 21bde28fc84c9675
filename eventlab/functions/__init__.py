"""Scalar column functions (``columns``: B1-B20) and distribution helpers
(``distributions``: H12)."""
