"""DataFrame operators: filtering, ranking, packaging, storage, state."""
