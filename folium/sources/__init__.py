"""Scans and sinks of files."""
