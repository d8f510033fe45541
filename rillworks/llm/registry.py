"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

_MODULES = ("urls", "ann", "lines", "decontam", "toxicity", "quality", "language", "bpe", "neardup", "passages", "audit", "trie", "jaccard")

QUERIES = {name: query for m in _MODULES for name, query in import_module(f"{__package__}.{m}").QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE = {name: sql for m in _MODULES for name, sql in import_module(f"{__package__}.{m}").ORACLE.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
