"""Whole jobs composed from the operators: matching a corpus, and the map-enrich-report chain."""
