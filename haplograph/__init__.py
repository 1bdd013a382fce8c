"""Spark-native haplotype assembly analytics: reads, overlaps, overlap graphs and consensus as DataFrames."""
