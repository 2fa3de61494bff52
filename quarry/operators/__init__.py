"""quarry.operators: DataFrame -> DataFrame building blocks."""

import sys

from quarry.operators.chunking import (chunk_records, dedup_by_hash, fixed_window_chunks,
                                       markdown_sections, merge_by_heading, recursive_chunks,
                                       token_pack)
from quarry.operators.context import citations, context_blocks
from quarry.operators.embed import WordVectors
from quarry.operators.evaluate import (attach_judgements, macro_average, query_metrics,
                                       rank_and_flatten)
from quarry.operators.fusion import fuse, hybrid_search, search
from quarry.operators.history import (append_turn, clean_history, history_tail, reduce_history,
                                      summary_input)
from quarry.operators.loading import chunk_files
from quarry.operators.margins import remove_repeated_margins, repeated_margins
from quarry.operators.postings import PostingsIndex
from quarry.operators.quantised_search import QuantisedIndex, approx_vector_search
from quarry.operators.refine import refined_terms
from quarry.operators.routing import route_files, skip_imported, supported_files
from quarry.operators.store import (delete_document, delete_documents, delete_records, list_records,
                                    upsert)
# ``text_search`` and ``vector_search`` are also the names of their modules;
# import those functions from the modules so the modules stay reachable.
from quarry.operators.text_search import LexemeIndex, text_matches
from quarry.operators.vector_search import vector_candidates

__all__ = sorted(n for n, v in list(globals().items())
                 if not n.startswith("_") and not isinstance(v, type(sys)))
