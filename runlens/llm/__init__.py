"""Training-data pipeline operators (quality, dedup, scoring, PII, tokens, HTML, mixing, ANN, classifier)."""
