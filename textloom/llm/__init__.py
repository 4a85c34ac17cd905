"""Operators for preparing training data: extraction, identification, mixing, counting, deduplication, scoring, scrubbing, encoding, quality and vector search.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
