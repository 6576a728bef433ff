"""Affine and orientation algebra on small matrices, and colour maps."""
