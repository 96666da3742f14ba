"""Plan helpers: shared storage, lineage cuts and skew-safe joins."""
