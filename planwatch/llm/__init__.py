"""Operators of a training-data pipeline: dedup, mixing, language, quality, licences, tokens, scoring, secrets."""
