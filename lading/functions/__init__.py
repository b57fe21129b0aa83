"""Column expressions and digests."""
