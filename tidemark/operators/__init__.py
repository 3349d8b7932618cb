"""Panel operators; import them from their modules."""
