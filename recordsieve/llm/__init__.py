"""Training-data operators: sharding, mixing, quality, toxicity, decontamination,
HTML extraction, repeated-passage removal, near duplicates, URL rules, LM scoring.

Nothing outside this subpackage imports it.
"""
