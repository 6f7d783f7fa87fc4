"""The registered queries of this subpackage. Importing the operators registers them."""

from __future__ import annotations

from lexframe.llm import decontaminate, filter_audit, html_text, langid, licenses, mixing, neardup, neighbours, prefix_trie, quality, secret_scan, shards, suffixes  # noqa: F401
from lexframe.llm.base import registered


def llm_queries() -> dict:
    return registered()[0]


def llm_oracles() -> dict:
    return registered()[1]
