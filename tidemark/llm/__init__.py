"""Corpus operators for language-model training data. Nothing outside this package imports it."""
