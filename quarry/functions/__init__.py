"""Column-level building blocks: text analysis, vectors, code packing."""
