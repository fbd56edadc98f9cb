"""Append-only logs that a running discovery writes and others may follow."""
