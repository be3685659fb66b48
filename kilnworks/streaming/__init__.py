"""Structured Streaming forms of the causal transforms."""
