"""Scans, sinks and the binding of event tables to monitoring sources."""
