"""Small Column helpers shared by all families."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_of(value: str | Column) -> Column:
    """Null text reads as empty text."""
    return F.coalesce(as_col(value), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def null_if_empty(value: Column) -> Column:
    return F.when(F.length(value) > 0, value)


def extract(value: str | Column, pattern: str, group: int = 0) -> Column:
    """First match or null (Spark gives an empty string for no match). A plain word is looked for as such."""
    if group == 0 and pattern.isalnum():
        return F.when(as_col(value).contains(pattern), F.lit(pattern))
    return null_if_empty(F.regexp_extract(as_col(value), pattern, group))


def contains_any(value: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | value.contains(word)
    return found


def lookup(value: Column, table: Mapping[str, object], default: object = None) -> Column:
    """CASE lookup in a small fixed table; null (or the default) when absent."""
    out = None
    for key, result in table.items():
        out = (F.when if out is None else out.when)(value == F.lit(key), F.lit(result))
    return out.otherwise(F.lit(default)) if default is not None else out


def first_rule(rules: Sequence[tuple[object, Column]], default: object = None) -> Column:
    """The label of the first rule that holds, in rule order."""
    out = None
    for label, condition in rules:
        out = (F.when if out is None else out.when)(condition, F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def present(items: Sequence[Column]) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def struct_rows(rows: Sequence[Mapping[str, object]]) -> Column:
    """A fixed rule table as one literal array of structs."""
    return F.array(
        *[F.struct(*[_literal(v).alias(k) for k, v in row.items()]) for row in rows]
    )


def _literal(value: object) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, (list, tuple)):
        return F.array(*[_literal(v) for v in value]) if value else F.array().cast("array<string>")
    if value is None:
        return F.lit(None).cast("string")
    return F.lit(value)


def with_rules(df: DataFrame, rows: Sequence[Mapping[str, object]], alias: str) -> DataFrame:
    """One output row per (input row, rule). The rules are literals in the plan, so
    no table is joined or broadcast and the growth factor is the rule count."""
    return df.withColumn(alias, F.explode(struct_rows(rows)))


def epoch_seconds(moment: Column) -> Column:
    """Unix seconds of a date or a zone-less timestamp read as UTC."""
    at = moment.cast("timestamp_ntz")
    days = F.unix_date(at.cast("date")).cast("long")
    return days * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
