"""Training-data operators: text scans, deduplication, scoring, formatting and extraction."""
