"""Training-data operators: deduplication, filtering, tokenisation, scoring.

Nothing outside this folder imports it.
"""
