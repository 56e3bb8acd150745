"""Outlier detection, classification and label filling on Spark tables."""
