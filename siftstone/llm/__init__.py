"""Corpus preparation for language-model training: ten operators over document tables."""
