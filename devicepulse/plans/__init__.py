"""Whole jobs and the queries registered with the check tool."""
