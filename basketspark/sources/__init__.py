"""Readers of store feeds and pages, and writers of snapshots."""
