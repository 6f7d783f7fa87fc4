"""What the operators of this subpackage share: whole tables, word patterns, written cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.session import cut_lineage, fresh_path

__all__ = ["WORD", "cut_lineage", "fresh_path", "register", "registered", "table", "whole"]

#: A word of plain text: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Registers a query under its name, with oracle SQL where there is one."""

    def put(function):
        _QUERIES[name] = function
        if sql:
            _ORACLES[name] = sql
        return function

    return put


def registered() -> tuple[dict, dict]:
    return dict(_QUERIES), dict(_ORACLES)


def whole(text: Column | str) -> Column:
    """The text, with a null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
