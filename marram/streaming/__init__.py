"""Structured Streaming: the run worker and keyed session state (ST1, ST3)."""
