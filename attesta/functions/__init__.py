"""Column-level functions: identity, text, extraction, redaction, vectors, guards."""
