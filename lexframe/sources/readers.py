"""Readers: inbox folders, sidecars, bundles, listing pages, rule files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexframe.functions.common import contains_any, text_of
from lexframe.functions.text import blank_to_null, normalize_title
from lexframe.rules import planning as PR
from lexframe.rules import tax as XR
from lexframe.rules import text as R

# Suffixes of text files, decoders in order of trial.
SUFFIXES = ("txt", "md", "text")
ENCODINGS = ("utf-8", "gbk", "gb18030", "big5", "latin-1")

SIDECAR_SCHEMA = (
    "filename string, title string, document_number string, source_url string, collection string, "
    "tax_policy string, tax_types array<string>, effect_status_hint string, expiry_date string"
)

# A collector gives rows of (filename, text, source_url); any function of that shape is one.
Collector = Callable[[SparkSession], DataFrame]


@F.pandas_udf(StringType())
def _decode_other(raw: pd.Series) -> pd.Series:
    """Text of bytes that are not UTF-8, by the first decoder that accepts them."""

    def one(data):
        if data is None:
            return None
        for name in ENCODINGS:
            try:
                return bytes(data).decode(name)
            except UnicodeDecodeError:
                continue
        return bytes(data).decode("utf-8", errors="replace")

    return raw.map(one)


def decode_bytes(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds text. Valid UTF-8 is decoded in the JVM; only the rest goes through Python."""
    raw = F.col(content)
    good = F.is_valid_utf8(raw.cast("string"))
    fine = files.filter(good).withColumn("text", raw.cast("string"))
    other = files.filter(~good).withColumn("text", _decode_other(raw))
    return fine.unionByName(other)


def scan_inbox(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, stem, text) of the text files below a folder; names that start with
    a dot or an underscore are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    kept = files.select("path", name.alias("filename"), "content").filter(
        suffix.isin(*SUFFIXES) & ~name.startswith(".") & ~name.startswith("_") & name.contains(".")
    )
    return decode_bytes(kept).select(
        "path", "filename", F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), "text"
    )


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of same-stem ``.meta.json`` files; a broken file gives nulls."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.meta.json")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .schema(SIDECAR_SCHEMA)
        .json(path)
    )
    return raw.withColumn("stem", F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json$", ""))


def collect_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Files with their sidecars; the file's own address stands in for a missing source."""
    files = scan_inbox(spark, path).withColumn("_stem", F.regexp_replace("stem", "^file:/+", "/"))
    side = read_sidecars(spark, path).withColumn("_stem", F.regexp_replace("stem", "^file:/+", "/"))
    rows = files.join(side.drop("stem", "filename"), "_stem", "left").drop("_stem")
    return rows.withColumn("source_url", F.coalesce(blank_to_null(F.col("source_url")), "path"))


def collect_all(spark: SparkSession, collectors: Iterable[Collector]) -> DataFrame:
    """Rows of several collectors as one table."""
    out = None
    for collect in collectors:
        rows = collect(spark).select("filename", "text", "source_url")
        out = rows if out is None else out.unionByName(rows)
    return out


def read_bundle(spark: SparkSession, path: str, jurisdiction: str) -> DataFrame:
    """Documents of one jurisdiction from ``{"documents": [...]}`` files."""
    bundle = spark.read.option("multiLine", True).json(path)
    return bundle.select(F.explode("documents").alias("d")).select("d.*").filter(
        F.col("jurisdiction") == jurisdiction
    )


def listing(rows: DataFrame, words: Sequence[str] = R.TITLE_WORDS, title: str = "title") -> DataFrame:
    """Listed documents whose title holds one of the words, each normalised title once (the
    smallest ``listed_no``)."""
    kept = rows.filter(contains_any(text_of(title), words)).withColumn(
        "_k", normalize_title(F.col(title), "collect")
    )
    return kept.groupBy("_k").agg(F.min_by(F.struct(*rows.columns), "listed_no").alias("_f")).select("_f.*")


def flatten_meta(groups: Column) -> Column:
    """``domainMetaList[].resultList[]`` to a map: blanks dropped, the first value of a key
    wins. Works inside the row."""
    fields = F.flatten(F.array_compact(F.transform(groups, lambda g: g["resultList"])))
    clean = F.transform(
        fields, lambda f: F.struct(F.trim(f["key"]).alias("key"), blank_to_null(f["value"]).alias("value"))
    )
    kept = F.filter(clean, lambda f: (F.length(f["key"]) > 0) & f["value"].isNotNull())
    keys = F.transform(kept, lambda f: f["key"])
    first = F.filter(kept, lambda f, i: F.array_position(keys, f["key"]) == i + 1)
    return F.map_from_entries(first)


# ---------------------------------------------------------------- rule files


def read_config(spark: SparkSession, path: str) -> dict:
    """A small JSON rule file from any file system Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def load_tax_rules(spark: SparkSession, path: str) -> dict:
    """Rates, surcharges and discounts from a rule file, checked before use."""
    data = read_config(spark, path)
    for name in ("rates", "surcharges", "discounts"):
        if name not in data:
            raise XR.RuleError(f"{name} is missing")
    XR.validate(data["rates"], data["surcharges"], data["discounts"])
    return data


def load_techniques(spark: SparkSession, *paths: str) -> list[dict]:
    """Techniques from rule files, checked; a later entry replaces an earlier one by code."""
    by_code: dict[str, dict] = {}
    for path in paths:
        items = read_config(spark, path).get("techniques") or []
        PR.validate(items)
        for item in items:
            by_code[item["code"]] = {**item, "conditions": [tuple(c) for c in item["conditions"]]}
    if not by_code:
        raise PR.TechniqueError("no techniques")
    return list(by_code.values())


def load_packs(spark: SparkSession, *paths: str) -> list[dict]:
    """Domain packs: routing words and status, without code."""
    packs = []
    for path in paths:
        pack = read_config(spark, path)
        for name in ("domain_id", "status", "keywords", "include", "exclude"):
            if name not in pack:
                raise XR.RuleError(f"{path}: {name} is missing")
        packs.append(pack)
    return packs


def keyword_conflicts(spark: SparkSession, packs: Sequence[dict]) -> DataFrame:
    """Words that more than one domain claims."""
    rows = [(w, p["domain_id"]) for p in packs for w in (*p["keywords"], *p["include"])]
    words = spark.createDataFrame(rows, "keyword string, domain_id string")
    return (
        words.groupBy("keyword")
        .agg(F.array_sort(F.collect_set("domain_id")).alias("domains"))
        .filter(F.size("domains") > 1)
    )
