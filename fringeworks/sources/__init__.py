"""Trace files, their catalog, and sinks."""
