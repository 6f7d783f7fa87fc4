"""Benchmark decontamination by a hash set of normalised test windows.

Items and documents become words: A-Z lower-cased, anything of digits, letters and characters
above ASCII is a word. A window is ten consecutive words of an item; an item of fewer words is
one window. The 64-bit hashes of all windows go with the plan to every scan while they are counted and at
most `SENT`: each window of each document is looked up there, and the words at the places found are
compared with the window's own. A larger set is the other side of a join with every window of
every document as a hash and a place; these longs are shuffled, no text is, and only documents with
a known hash are read again to compare the words.

Defined cases: a null text has no words and no hits; an item without words has no window; items
with one text are all found; an item without id is hit but not listed; repeated rows are judged
alike; an empty benchmark hits nothing; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.llm.base import cut_lineage, register, table, whole

#: Words of a window, and hashes that are sent to every task at most (4 MB).
WINDOW, SENT = 10, 50_000

_BREAK = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def words_of(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"[^{_BREAK}]+"), F.lit(0))
    ascii_only = lambda w: F.octet_length(w) == F.char_length(w)
    return F.transform(found, lambda w: F.when(ascii_only(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(len, text, items): each distinct window with the ids of its items."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(whole("text")).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(width)))
    last = F.size("words") - F.col("len")
    rows = rows.select("item", "words", "len", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    rows = rows.select("item", "len", F.concat_ws(" ", F.slice("words", F.col("pos") + 1, F.col("len"))).alias("text"))
    return rows.groupBy("len", "text").agg(F.collect_set("item").alias("items"))


class Windows:
    """The windows of a benchmark, written once with their hashes and those of their first words, and the hashes to
    send if they are few enough."""

    def __init__(self, benchmark: DataFrame, width: int = WINDOW, sent: int = SENT):
        hashes = F.transform(F.split("text", " "), lambda w: F.xxhash64(w))
        rows = item_windows(benchmark, width).withColumn("h", hashes).select("*", F.xxhash64("h").alias("hash"), F.col("h")[0].alias("first"))
        self.table = cut_lineage(rows.drop("h"), "windows")
        counts = self.table.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()
        self.lengths = sorted(r["len"] for r in counts)
        self.known: dict[int, tuple[list[int], list[int]]] | None = None
        if sum(r["n"] for r in counts) <= sent:
            found = self.table.select("len", "first", "hash").collect()
            self.known = {n: tuple(sorted({r[c] for r in found if r["len"] == n}) for c in ("first", "hash")) for n in self.lengths}


def keyed(docs: DataFrame) -> DataFrame:
    """The documents as structs `__row` with the key (__id, __key) of id and text."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("__id"), F.md5(whole("text").cast("binary")).alias("__key")]
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), *key, whole("text").alias("__text"))


def _in(values: list[int], what: str) -> str:
    return f"{what} IN ({','.join(f'{v}L' if v > -(2**63) else 'bigint(-9223372036854775808)' for v in values)})"


_WORDS_AT = "CASE WHEN size(h) >= {n} THEN sequence(0, size(h) - {n}) ELSE cast(array() AS array<int>) END"


def _looked_up(rows: DataFrame, windows: Windows) -> DataFrame:
    """(__id, __key, pos, len, items) by the hashes sent to every scan."""
    # `inline` keeps the optimizer from putting the arrays' making into every place that reads them.
    rows = rows.select("__id", "__key", F.inline(F.array(F.struct(words_of(F.col("__text")).alias("words")))))
    rows = rows.select("__id", "__key", "words", F.inline(F.array(F.struct(F.transform("words", lambda w: F.xxhash64(w)).alias("h")))))
    every = []
    for n, (first, hashes) in windows.known.items():
        likely = f"filter({_WORDS_AT.format(n=n)}, i -> {_in(first, 'h[i]')} AND {_in(hashes, f'xxhash64(slice(h, i + 1, {n}))')})"
        every.append(f"transform({likely}, i -> struct(i AS pos, {n} AS len, concat_ws(' ', slice(words, i + 1, {n})) AS text))")
    found = rows.select("__id", "__key", F.expr(f"inline(concat({', '.join(every)}))"))
    # Only places with a known hash leave the scan; the windows are few here.
    return cut_lineage(found, "likely").join(F.broadcast(windows.table), ["len", "text"]).select("__id", "__key", "pos", "len", "items")


def _joined(rows: DataFrame, windows: Windows) -> DataFrame:
    """The same by a join of the hashes of all windows of all documents."""
    hashes = F.transform(words_of(F.col("__text")), lambda w: F.xxhash64(w))
    at = _WORDS_AT + ", i -> struct(i AS pos, {n} AS len, xxhash64(slice(h, i + 1, {n})) AS hash"
    every = ", ".join(f"transform({at.format(n=n)}))" for n in windows.lengths)
    places = rows.select("__id", "__key", F.inline(F.array(F.struct(hashes.alias("h"))))).select("__id", "__key", F.expr(f"inline(concat({every}))"))
    likely = places.join(windows.table, ["len", "hash"]).groupBy("__id", "__key").agg(F.collect_set(F.struct("pos", "len", "text", "items")).alias("likely"))
    again = rows.select("__id", "__key", "__text").join(cut_lineage(likely, "likely"), ["__id", "__key"])
    again = again.select("__id", "__key", "likely", F.inline(F.array(F.struct(words_of(F.col("__text")).alias("words")))))
    same = lambda x: F.concat_ws(" ", F.slice("words", x["pos"] + 1, x["len"])) == x["text"]
    return again.select("__id", "__key", F.inline(F.filter("likely", same))).select("__id", "__key", "pos", "len", "items")


def found_places(rows: DataFrame, windows: Windows) -> DataFrame:
    """(__id, __key, places): the places of windows in keyed documents, with their items. Only documents with any."""
    if not windows.lengths:
        none = "array<struct<pos:int,len:int,items:array<string>>>"
        return rows.where("false").select("__id", "__key", F.array().cast(none).alias("places"))
    found = _joined(rows, windows) if windows.known is None else _looked_up(rows, windows)
    places = F.array_sort(F.collect_set(F.struct("pos", "len", "items")))
    return found.groupBy("__id", "__key").agg(places.alias("places"))


def _covered(places: str) -> Column:
    """Words under any of the places, which are sorted by their start."""
    return F.expr(
        f"aggregate({places}, struct(0 AS upto, 0L AS n), (a, x) -> struct(greatest(a.upto, x.pos + x.len) AS upto,"
        " a.n + greatest(0, x.pos + x.len - greatest(a.upto, x.pos)) AS n), a -> a.n)"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, sent: int = SENT) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    rows = keyed(docs.select("doc_id", "text"))
    found = found_places(rows, Windows(benchmark, width, sent))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda x: x["items"]))))
    found = found.select("__id", "__key", _covered("places").alias("n_hit"), ids.alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    n_words = F.regexp_count("__text", F.lit(f"[^{_BREAK}]+")).cast("long").alias("n_words")
    rows = rows.select(F.col("__row.doc_id").alias("doc_id"), "__id", "__key", n_words)
    return rows.join(found, ["__id", "__key"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, sent: int = SENT) -> DataFrame:
    """The documents without a window of the benchmark, whole and unchanged."""
    rows = keyed(docs)
    found = found_places(rows, Windows(benchmark, width, sent)).select("__id", "__key")
    return rows.join(cut_lineage(found, "found"), ["__id", "__key"], "left_anti").select("__row.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, sent: int = SENT) -> DataFrame:
    """All documents, with the words under a window removed from the text."""
    rows = keyed(docs)
    rows = rows.join(found_places(rows, Windows(benchmark, width, sent)), ["__id", "__key"], "left").select("__row.*", F.col("places").alias("__places"))
    pieces = F.regexp_extract_all("text", F.lit(f"[{_BREAK}]*[^{_BREAK}]+|[{_BREAK}]+$"), F.lit(0))
    rows = rows.withColumn("__pieces", pieces)
    kept = F.filter("__pieces", lambda piece, i: ~F.exists("__places", lambda x: (x["pos"] <= i) & (i < x["pos"] + x["len"])))
    rows = rows.withColumn("text", F.when(F.col("__places").isNotNull(), F.concat_ws("", kept)).otherwise(F.col("text")))
    return rows.select(*docs.columns)


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no window of the benchmark."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS t
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM dw),
pos AS (SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS a FROM dp),
hit AS (SELECT pos.r, pos.p, pos.n, win.item FROM
    (SELECT r, p, n, array_to_string(a[1:n], ' ') AS t FROM pos, lens WHERE len(a) >= n) pos JOIN win USING (n, t)),
cov AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN ids USING (r)
"""


@register("op3_decontamination", OP3_SQL)
def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document with the words and items of the benchmark found in it."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
