"""Operators for preparing text corpora: deduplication, extraction, scoring, scanning, packing and archives."""
