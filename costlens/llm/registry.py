"""Queries of this subpackage and the SQL that states their results, where SQL can."""

from __future__ import annotations

import corpus_pipeline
from costlens.llm import ann, bpe, decontaminate, langid, lexical, licenses, line_dedup, lm, near_duplicates, prefix_trie, quality, sharding, suffix_dedup

_MODULES = (near_duplicates, suffix_dedup, lm, langid, line_dedup, quality, decontaminate, bpe, sharding, ann, licenses, lexical, prefix_trie)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
