"""Registered queries over the supplied tables."""

from __future__ import annotations

import importlib

MODULES = ("listing_queries", "access_queries", "span_queries", "integrity_queries", "lifecycle_queries", "layout_queries", "credential_queries", "stream_queries")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"casemesh.plans.{name}")
