"""Training-data operators: tokenising, archives, language, packing, dedup, search, toxicity, chat, quality."""
