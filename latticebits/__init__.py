"""Candidate-pair graph analytics on Spark: relations, candidate pairs, splits, models, bits."""

from latticebits.functions.columns import code_length, per_positive, per_sample

__all__ = ["code_length", "per_positive", "per_sample"]
__version__ = "0.1.0"
