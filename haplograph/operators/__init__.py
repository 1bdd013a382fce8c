"""Joins, overlaps, graph rewrites, consensus, evidence and analysis as DataFrame operators."""
