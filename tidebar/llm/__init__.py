"""Operators that prepare training corpora: extraction, tokens, deduplication, sanitisation, filtering."""
