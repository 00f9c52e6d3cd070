"""Column functions: text clean-up, tokens, identifiers, languages, digests."""
