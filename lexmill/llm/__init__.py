"""Operators for preparing language-model training data (fingerprints, tokens, mixes, extraction, formatting)."""
