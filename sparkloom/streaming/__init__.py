"""Structured Streaming forms of the operators on updates."""
