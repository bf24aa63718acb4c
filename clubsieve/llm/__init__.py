"""Operators of a training-data pipeline: quality, near copies, search, toxicity, repeats, tokens, packing, chat, secrets."""
