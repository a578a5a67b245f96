"""Landed payloads to item rows, the source registry, and the gold tables."""
