"""Column-level functions: normalisers, predicates, similarity."""
