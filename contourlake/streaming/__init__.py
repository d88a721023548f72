"""Structured Streaming: an online monitor of pitch sessions."""
