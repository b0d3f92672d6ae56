"""Resumable and running computations as Structured Streaming."""
