"""Plan-level helpers: size-checked broadcast, shared facts, global positions."""
