"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import articles, audits, dashboard, earnings, legacy, messages, news, parsing, portfolio, published, relational, reports, series, streams, versions
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "articles", "audits", "dashboard", "earnings", "legacy", "messages", "news", "parsing", "portfolio", "published", "relational", "reports", "series", "streams", "versions"]
