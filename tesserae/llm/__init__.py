"""Training-data operators: deduplication, filtering, extraction, tokenisation."""
