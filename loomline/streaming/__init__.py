"""Structured Streaming forms of the event operators."""

from .events import block_rollover, keyed_chain, session_stats, window_stats  # noqa: F401
