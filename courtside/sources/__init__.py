"""Readers, feed normalisers and writers."""
