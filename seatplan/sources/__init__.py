"""Typed table sources, driver-table bindings and versioned snapshots."""
