"""Distributed classifiers and outlier detectors."""
