"""Scalar functions and per-document routines."""
