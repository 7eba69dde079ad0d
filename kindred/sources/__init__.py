"""Typed table scans, message parsing and sinks."""
