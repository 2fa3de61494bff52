"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it, so it
can be removed as a whole.  Every module holds one operator with its general
interface; ``quarry.llm.queries`` derives the registered ``opN_*`` queries.
"""
