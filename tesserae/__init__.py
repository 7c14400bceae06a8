"""Labelled sparse matrices as DataFrames: statistics, quality control, selection, testing and reduction on Spark."""
