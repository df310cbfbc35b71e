"""Readers, file analysis, versioned snapshots."""
