"""Column builders: text cleaning, tokens and n-grams, numeric helpers, ranking arrays."""
