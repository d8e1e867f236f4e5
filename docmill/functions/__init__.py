"""Scalar expressions, predicates and accumulators as Spark columns."""
