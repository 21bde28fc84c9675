"""Structured Streaming forms of gap events and daily totals (``sessions``)."""
