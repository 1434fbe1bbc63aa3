"""Structured Streaming forms of scoring, debouncing and the fleet summary."""
