"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from siltstone.plans import boards, changes, chunks, grades, graphs, migration, retrieval, scans, streams

PARTS = (retrieval, chunks, grades, graphs, migration, boards, scans, streams, changes)
QUERIES: dict = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
