"""Operators for preparing training text: near-duplicate removal, quality
rules, sharding, benchmark decontamination, token files, token counts, secret
scans, source mixing, URL filters, HTML extraction, lexical search, hard
negatives and chat formatting.

Nothing else in the package imports this subpackage.
"""
