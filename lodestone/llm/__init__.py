"""Operators for large text corpora used in model training: quality, language, toxicity, near copies, mixing, packing, chat."""
