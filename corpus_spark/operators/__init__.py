"""Operators: dataset-level computations, DataFrame in, DataFrame out."""
