"""Column functions: text, n-grams, keyed draws, token noise."""
