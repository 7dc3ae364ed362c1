"""Fixture views, registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ["track_queries", "match_queries", "cue_queries", "upload_queries", "entity_queries", "page_queries", "link_queries", "detect_queries", "text_queries", "stream_queries"]


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(import_module(f"{__name__}.{name}").query, attribute))
    return found


def all_queries() -> dict:
    return _collect("queries")


def all_oracles() -> dict:
    return _collect("oracles")
