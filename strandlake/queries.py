"""All registered queries of the sequencing operators, with their SQL."""

from .plans import alignment_queries, more_queries, read_queries, variant_queries

_MODULES = (read_queries, variant_queries, alignment_queries, more_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
