"""Structured Streaming jobs: audit tail, shipper, continuous re-validation, hourly monitor."""
