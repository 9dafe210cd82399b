"""Operators for training-data pipelines, apart from the transcript library."""
