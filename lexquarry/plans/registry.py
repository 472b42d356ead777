"""All registered queries and their oracle statements."""

from __future__ import annotations

from . import answers, driver, evaluation, families, layout, ledger, links, models, pages, periods, quotes, record, replacements, retrieval, review, texts, timeline, trust, typed, values  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "bm25_topk"
