"""Operators on free text for training data; nothing else in the package imports this subpackage."""
