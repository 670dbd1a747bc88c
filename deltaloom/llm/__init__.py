"""Training-data operators: dedup, filters, tokenisation, packing, media columns.

Nothing else in the library imports this subpackage; `queries` registers its
operators for the driver and `corpus_pipeline.py` chains five of them.
"""
