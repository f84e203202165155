"""Operators of a training-data pipeline over large document tables.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains them.
"""
