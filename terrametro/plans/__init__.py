"""Whole plans: operators composed over concrete tables."""
