"""Operators for building language-model training data at scale.

Nothing outside this package imports it.  Every operator is one module with a
general interface; :mod:`docmill.llm.queries` holds the thin registered queries.
"""
