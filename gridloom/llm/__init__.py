"""Training-data operators: dedup, tokenization, language ID, extraction, formatting, packing."""
