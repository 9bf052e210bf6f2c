"""Operators that a training-data pipeline needs besides retrieval.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
