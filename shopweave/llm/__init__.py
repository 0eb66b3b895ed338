"""Training-data operators: language id, quality, dedup, packing, search, coding, toxicity."""
