"""Structured Streaming forms of the admission, audit and validation jobs."""
