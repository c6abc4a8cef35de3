"""All registered queries over the star-schema tables, with their SQL."""

from __future__ import annotations

from tenderspark.plans import matrix, operations, prompts, search, streams, texts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for family in (matrix, texts, search, operations, prompts, streams):
    QUERIES |= family.R.queries
    ORACLES |= family.R.oracles
