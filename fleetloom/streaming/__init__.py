"""Structured Streaming operators: waits for a status, action plans, node states per window."""
