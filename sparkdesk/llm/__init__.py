"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it but ``__spark_entry__`` and
``corpus_pipeline``.  Every operator selects the columns it names and keeps
its own working columns apart from the caller's, so extra input columns with
any name are harmless.
"""
