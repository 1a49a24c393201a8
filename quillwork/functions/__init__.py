"""Columnar expressions and text kernels."""
