"""Operators: listing scans, detail extraction, enrichment, paging, statistics."""
