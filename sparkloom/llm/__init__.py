"""Training-data operators: chat, media, dedup, tokens, packing, licences, toxicity, languages."""
