"""DataFrame operators over positioned words, table cells, page texts and ledgers."""
