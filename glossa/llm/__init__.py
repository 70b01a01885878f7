"""Training-data operators: sharding, dedup, decontamination, filtering, archives, media, tokens.

Nothing outside this folder imports it; it can be removed as a whole.
"""
