"""Operators of a training-data pipeline: dedup, decontamination, tokenizing, scoring, search, archives, sharding.

Nothing else in the library imports this package; deleting the folder (with ``corpus_pipeline.py``) leaves the rest whole.
"""
