"""Operators that prepare code and its texts for training language models."""
