"""Training-data operators: PII, decontamination, deduplication, mixing, tokens, archives, extraction, quality.

Nothing outside this subpackage imports it.
"""
