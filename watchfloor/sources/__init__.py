"""Readers and writers: telemetry, rule corpora, the knowledge base, vulnerability feeds, results."""
