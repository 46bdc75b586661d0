"""Scalar functions: text, hashes, URLs, pages. All are Column expressions, but for the stemmer."""
