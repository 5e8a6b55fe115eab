"""Structured Streaming over the events table; beyond the batch operators."""
