"""Registered queries of the search and analytics operators, with their SQL."""

from __future__ import annotations

from lexiloom.plans import building, changed_search, editorial, evaluation, locale_search, placement, readers, search_analytics, search_ranking

FLAGSHIP = "trends_daily"
ALL = search_analytics.QUERIES | search_ranking.QUERIES | locale_search.QUERIES | evaluation.QUERIES | editorial.QUERIES | building.QUERIES | changed_search.QUERIES | placement.QUERIES | readers.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
