"""Binning, index statistics and the cardinality estimator: computations over values and their counts."""
