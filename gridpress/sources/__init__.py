"""Readers for landed files: delimited text, JSON payloads, file manifests."""
