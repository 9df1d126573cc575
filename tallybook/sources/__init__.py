"""Scans of exports, rule and budget files, labelled history; sinks."""
