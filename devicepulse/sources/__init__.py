"""Readers and writers: tables, JSON requests and responses, models, scenarios."""
