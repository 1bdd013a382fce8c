"""Scalar functions on sequences, qualities, alignments and edges."""
