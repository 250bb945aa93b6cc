"""Training-data operators: packing, deduplication, tokenizers, extraction, quality, licences."""
