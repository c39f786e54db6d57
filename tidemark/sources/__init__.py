"""Scans, sinks and the versioned feature store."""
