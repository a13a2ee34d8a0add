"""Operators for training data: deduplication, filters, tokens, packing and sharding. Nothing else imports them."""
