"""Folds of commands over job state, in batch and in streams."""
