"""Column functions: text, markup, trigrams, keys, headers, vectors, scores."""
