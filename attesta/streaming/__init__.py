"""Structured Streaming forms of ingestion, ledger, leases and audit chains."""
