"""Collects the registered queries and their oracle SQL."""

from __future__ import annotations

import importlib

FAMILIES = ("temporal", "retrieval", "text", "tax", "qa", "verify", "planning", "evolve", "streams", "rankings")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        module = importlib.import_module(f"lexframe.plans.{family}")
        for name, value in getattr(module.family, attribute).items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = value
    return out


def all_queries() -> dict:
    return _collect("queries")


def all_oracles() -> dict:
    return _collect("oracle")
