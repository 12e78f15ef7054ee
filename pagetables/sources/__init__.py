"""Readers for token tables and writers for tables and ledgers."""
