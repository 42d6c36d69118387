"""Structured Streaming over transaction logs."""
