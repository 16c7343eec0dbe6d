"""All queries of the library over the driver's tables, by name, with their SQL."""

from . import analytics, choice, cjk, claims, discovery, drafts, graph, profiles, prose, texts, upkeep
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analytics", "choice", "cjk", "claims", "discovery", "drafts", "graph", "profiles", "prose", "texts", "upkeep"]
