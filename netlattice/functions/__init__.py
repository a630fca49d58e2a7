"""Column expressions: addresses, prefixes, predicates."""
