"""Operators for preparing large text, page and vector corpora for training."""
