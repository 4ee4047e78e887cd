"""Plan-shaping helpers: size-checked broadcast, skew-safe ranking, lineage cuts."""
