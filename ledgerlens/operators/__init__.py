"""DataFrame operators: normalisation, profile features, split, TF-IDF, evaluation,
explanation and the model registry."""
