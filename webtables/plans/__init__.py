"""Registered queries over the given tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ["pages", "texts", "sites", "works", "streams"]


def _catalogs():
    return [import_module(f"webtables.plans.{m}").catalog for m in MODULES]


def all_queries() -> dict:
    return {k: v for c in _catalogs() for k, v in c.queries.items()}


def all_sql() -> dict[str, str]:
    return {k: v for c in _catalogs() for k, v in c.sql.items()}


def flagship(spark, sf):
    from webtables.plans.works import nav_links_ranked

    return nav_links_ranked(spark, sf)
