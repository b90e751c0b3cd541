"""Fold training, selection, attribution and scoring on Spark ML."""
