"""Training-data operators: PII, quality, mixing, tokens, toxicity, near-duplicates, language, packing, search."""
