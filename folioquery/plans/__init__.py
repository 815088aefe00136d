"""Whole plans: corpus build, search, evaluation."""
