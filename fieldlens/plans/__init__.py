"""Composed jobs and the registry of queries."""

from __future__ import annotations


def _registry():
    from fieldlens.plans import court_queries, cricket_queries, delivery_queries, identity_queries, stream_queries  # noqa: F401
    from fieldlens.plans import registry

    return registry


def all_queries():
    return dict(_registry().QUERIES)


def all_oracles():
    return dict(_registry().ORACLES)
