"""Linkage steps that work on tables that grow."""
