"""Contract-checked reads and provenance-carrying writes."""
