"""Operators of a training-data pipeline, each with its query and oracle.

``common`` holds small helpers; one module per operator; ``catalog`` lists the
registered queries.  Nothing outside this package imports it except
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
