"""Training-data operators: ten building blocks of a corpus pipeline and their queries.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
