"""Every query of the core and its SQL."""

from tidemark.operators import bitemporal, history, outliers, rolling
from tidemark.plans import company, extra, features, points, review, scores, texts
from tidemark.sources import stamps

_MODULES = (bitemporal, outliers, rolling, stamps, history, scores, points, features, texts, extra, company, review)
CORE = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
CORE_SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
