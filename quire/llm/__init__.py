"""Training-data operators: language id, extraction, search, tokens, quality, sharding, dedup, packing, licences."""
