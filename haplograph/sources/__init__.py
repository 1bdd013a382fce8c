"""Readers and writers of sequence, alignment, overlap and graph files."""
