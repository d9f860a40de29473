"""Operators of a training-data pipeline over document tables.

One module per operator; ``queries.py`` registers their thin queries.  Nothing
outside this package (but ``corpus_pipeline.py`` and ``__spark_entry__.py``)
imports it.
"""
