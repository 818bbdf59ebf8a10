"""Training-data operators: scoring, deduplication, mixing and tokenisation."""
