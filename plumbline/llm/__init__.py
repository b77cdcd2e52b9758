"""Training-data operators: quality, de-duplication, tokens, mixing, extraction and vector search."""
