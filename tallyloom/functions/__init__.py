"""Column-level semantics of report cells."""
