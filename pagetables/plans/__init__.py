"""Operator chains: words to ledgers, words to tables."""
