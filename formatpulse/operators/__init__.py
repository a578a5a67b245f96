"""Operators over domain-shaped DataFrames (see ``formatpulse.schemas``)."""
