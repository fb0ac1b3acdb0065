"""Operators for corpora of model and annotator output. Nothing outside this package imports it."""
