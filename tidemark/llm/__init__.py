"""Operators that prepare a text corpus for language-model training."""
