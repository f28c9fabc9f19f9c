"""Training-data operators: packing, near-duplicate joins, language, licenses, tokens, quality and vector search."""
