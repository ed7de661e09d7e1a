"""Whole studies as one plan each: folds, methods and seeds are keys, not loops."""
