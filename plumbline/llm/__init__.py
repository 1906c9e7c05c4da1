"""Training-data operators: packing, search, language, archives, near duplicates, tokens, licences, toxicity, PII, quality."""
