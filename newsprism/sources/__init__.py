"""Readers and adapters: every derived view starts from the supplied tables."""
