"""Training-data operators: dedup, packing, tokenisation, scans, media and classification.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
