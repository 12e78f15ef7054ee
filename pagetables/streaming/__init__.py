"""Structured Streaming versions of the text, audit and ledger operators."""
