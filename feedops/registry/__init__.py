"""Checked queries: every operator run on the shared test tables, with its SQL.

``QUERIES`` maps a name to ``fn(spark, folder) -> DataFrame``; ``ORACLE`` maps
the names that plain SQL can express to that SQL.
"""

from __future__ import annotations

from feedops.registry import (
    chains,
    diffs,
    discovery,
    entities,
    feeds,
    joining,
    masking,
    merging,
    profiling,
    querying,
    writing,
)

QUERIES = {}
ORACLE = {}
for part in (discovery, feeds, querying, joining, merging, diffs, profiling, masking, entities, writing, chains):
    QUERIES.update(part.REGISTRY.queries)
    ORACLE.update(part.REGISTRY.oracle)
