"""Streams of postings: idempotent landing, refreshed months, near-duplicate alerts."""
