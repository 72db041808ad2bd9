"""Query catalogue and session helpers."""
