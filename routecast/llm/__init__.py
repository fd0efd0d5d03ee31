"""Training-data operators: fingerprints, deduplication, packing, quality, toxicity, chat, tokens, secrets, language."""
