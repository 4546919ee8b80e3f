"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``QUERIES`` maps query names to
``(spark, sf_dir) -> DataFrame``; ``ORACLE_SQL`` has the DuckDB statement of
those that SQL can express.
"""
