"""Relational operators over corpora, indexes and hits."""
