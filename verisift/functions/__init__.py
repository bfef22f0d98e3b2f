"""Column-level building blocks: predicates, scalar expressions, type classes."""
