"""Scans, sinks, merges and change sets."""
