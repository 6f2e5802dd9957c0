"""Operators for language-model training data over documents."""
