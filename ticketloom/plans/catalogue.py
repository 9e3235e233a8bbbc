"""Loads every module that registers queries."""

from __future__ import annotations

import importlib

from ticketloom.plans import registry

MODULES = [
    "analytics_queries",
    "relational_queries",
    "text_queries",
    "retrieval_queries",
    "evaluation_queries",
    "routing_queries",
    "draft_queries",
    "source_queries",
    "stream_queries",
]


def all_queries() -> dict[str, registry.Query]:
    for module in MODULES:
        importlib.import_module(f"ticketloom.plans.{module}")
    return registry.CATALOGUE
