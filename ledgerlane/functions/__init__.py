"""Column expressions: identifiers, money, dates, cell coercion, digests, statistics."""
