"""Readers, writers and the discovery of raw files."""
