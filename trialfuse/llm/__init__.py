"""Training-data operators: deduplication, decontamination, scoring, tokenising and media fingerprints.

Nothing outside this subpackage imports it.
"""
