"""Operators of a training-data pipeline, each a ``DataFrame -> DataFrame`` function.

Nothing outside this subpackage imports it. ``queries.py`` binds every operator to the
given tables; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
