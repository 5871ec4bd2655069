"""What the entry adds: all queries of this subpackage with the pipeline, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from scorekit.llm import oracle, queries

REGISTRY = {**queries.REGISTRY, "pipeline": corpus_pipeline.run}
SQL = {**oracle.SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
