"""Operators on images, by family."""
