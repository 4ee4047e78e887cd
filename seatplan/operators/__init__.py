"""Operators over the booking tables: reports, search, validation and change jobs."""
