"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .operators import anchors, bookkeeping, classify, context, conversation, crossrefs, entities, evaluation, graph, kept, more, neighbours, parsing, relationships, retrieval, steps, stores  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES  # noqa: F401
from .sources import loaders  # noqa: F401
from .streaming import progress, status  # noqa: F401

FLAGSHIP = "ret_20_cited_context"
