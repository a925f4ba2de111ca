"""Every query of this subpackage and its SQL."""

from tidemark.llm import matching, packing, stuffing, tokens, topn

_MODULES = (topn, matching, tokens, packing, stuffing)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
