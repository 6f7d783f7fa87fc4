"""Regulation text to header columns and a table of text blocks.

A text is cut at its headings inside the row, by look-ahead splits; the blocks are then
exploded once and shuffled once by document, and windows carry chapter, section, article
and paragraph down the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions import text as T
from lexframe.functions.common import text_of
from lexframe.rules import text as R
from lexframe.session import cut_lineage

TOP = "|".join(p.lstrip("^") for p in (R.CHAPTER, R.SECTION))
OPENS = "|".join(p.lstrip("^") for p in (R.ARTICLE, R.CN_ITEM))
ANY = "|".join(
    p.lstrip("^") for p in (R.CHAPTER, R.SECTION, R.ARTICLE, R.PARAGRAPH, R.ITEM, R.CN_ITEM)
)
def parse_header(df: DataFrame, text: str = "text", source_url: str = "source_url") -> DataFrame:
    """Number, issuer, title, hierarchy and dates of each text; unknown stays null and is
    named in ``review_reasons``. What several columns read is a column first, so that a text
    is cut and searched once."""
    body = text_of(text)
    first, joined = T.number_places(body)
    out = df.withColumns(
        {
            "_first": first,
            "_joined": joined,
            "_lines": T.title_lines(body),
            "_effective": F.regexp_extract(body, R.EFFECTIVE_DATE, 0),
            "_expiry": F.regexp_extract(body, R.REPEAL_DATE, 0),
        }
    ).withColumn("document_number", T.number_at(F.col("_first"), F.col("_joined")))
    out = out.withColumns(
        {
            "issuer": T.issuer_of(F.col("document_number")),
            "issuer_inferred": T.issuer_inferred(F.col("document_number")),
            "title": T.title_among(F.col("_lines"), F.col("document_number")),
            "publish_date": T.publish_date(F.col("document_number")),
            "effective_date": T.date_in(F.col("_effective"), R.EFFECTIVE_DATE),
            "expiry_date": T.date_in(F.col("_expiry"), R.REPEAL_DATE),
        }
    ).drop("_first", "_joined", "_lines", "_effective", "_expiry")
    out = out.withColumn("_found", T.hierarchy_by_title(F.col("title"), F.col("issuer")))
    found = F.col("_found")
    out = out.withColumns(
        {
            "hierarchy_level": F.coalesce(found, F.lit(R.DEFAULT_HIERARCHY)),
            "review_reasons": T.review_reasons(
                F.col("document_number"), found, F.col("effective_date"), F.col(source_url)
            ),
        }
    )
    return out.withColumn("requires_review", F.size("review_reasons") > 0).drop("_found")


def _with_segments(rows: DataFrame, text: str) -> DataFrame:
    """Adds the stripped lines and the raw blocks, each starting at its heading. Paragraphs and arabic items
    only count as headings once an article or a Chinese-numbered item has been seen. Each step is a column,
    as an expression that is named twice is worked out twice. The cut takes the line break with it: a pattern
    that starts with one is looked for at the breaks alone."""
    clean = F.concat(F.lit("\n"), F.array_join("_lines", "\n"))
    top = F.slice("_top", 2, F.greatest(F.size("_top"), F.lit(1)))
    rest = F.split(F.get("_halves", F.lit(1)), rf"\n(?={ANY})")
    return (
        rows.withColumn("_lines", F.transform(T.lines_of(F.col(text)), T.strip))
        .withColumn("_halves", F.split(clean, rf"\n(?={OPENS})", 2))
        .withColumn("_top", F.split(F.get("_halves", F.lit(0)), rf"\n(?={TOP})"))
        .withColumn("_segments", F.concat(top, F.coalesce(rest, F.array().cast("array<string>"))))
    )


def whole_text_body(lines: Column, number: Column, title: Column) -> Column:
    """The stripped lines of a text without its number and title lines and without blank lines."""
    top = F.array_remove(F.slice(lines, 1, 3), T.strip(text_of(number)))
    top = F.array_remove(top, T.strip(text_of(title)))
    rest = F.slice(lines, 4, F.greatest(F.size(lines), F.lit(1)))
    return F.array_join(F.filter(F.concat(top, rest), lambda s: F.length(s) > 0), "\n")


def split_blocks(
    parsed: DataFrame, key: str, text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per chapter, section, article, paragraph and item, in text order. Texts
    without any structure but of useful length become one whole-text article."""
    # The texts move to the partition of their key whole, before they are cut. The blocks are exploded from an
    # expression: of a column, Spark would also filter by its size and cut every text once more for that.
    raw = parsed.select(key, *carry, text, "document_number", "title").repartition(key)
    body = whole_text_body(F.col("_lines"), F.col("document_number"), F.col("title"))
    raw = _with_segments(raw, text).withColumn("_body", F.when(F.size("_segments") == 0, body))
    blocks = F.when(F.size("_segments") > 0, F.col("_segments")).when(
        F.length("_body") >= R.MIN_WHOLE_TEXT_CHARS, F.array("_body")
    )
    rows = raw.select(
        key, *carry, (F.size("_segments") == 0).alias("_whole"), F.posexplode(blocks).alias("order_index", "_raw")
    )
    rows = rows.withColumn(
        "article_no",
        F.when(F.col("_whole"), F.lit("")).otherwise(F.regexp_extract("_raw", f"^(?:{ANY})", 0)),
    )
    token = F.col("article_no")
    kind = (
        F.when(F.col("_whole"), F.lit("whole"))
        .when(token.endswith("章"), F.lit("chapter"))
        .when(token.endswith("节"), F.lit("section"))
        .when(token.endswith("条"), F.lit("article"))
        .when(token.startswith("（") | token.startswith("("), F.lit("paragraph"))
        .when(F.substring(token, 1, 1).between("0", "9"), F.lit("item"))
        .otherwise(F.lit("cn_item"))
    )
    rows = rows.withColumn("_kind", kind)
    rows = rows.withColumn(
        "_line", F.when(~F.col("_whole"), T.strip(F.substring_index("_raw", "\n", 1)))
    )
    rest = T.strip(F.expr("substring(_raw, length(article_no) + 1)"))
    below = T.strip(F.expr("substring(_raw, length(substring_index(_raw, '\\n', 1)) + 1)"))
    rows = rows.withColumns(
        {
            "content": F.when(F.col("_kind").isin("chapter", "section"), below).otherwise(rest),
            "article_no": F.when(
                F.col("_kind") == "paragraph",
                F.translate("article_no", "()", "（）"),
            ).otherwise(F.col("article_no")),
        }
    ).drop("_raw")
    return _number(rows, key)


def _number(rows: DataFrame, key: str) -> DataFrame:
    running = Window.partitionBy(key).orderBy("order_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def last(kind: str, value: str, *closing: str) -> Column:
        """(value, place) of the last row of the kind, unless a row of a closing kind came after it. All
        kinds share one window, and with it one sort."""
        own = F.when(F.col("_kind") == kind, F.struct(F.col(value).alias("no"), F.col("order_index").alias("at")))
        none = F.struct(F.lit(None).cast("string").alias("no"), F.lit(None).cast("int").alias("at"))
        return F.last(own.when(F.col("_kind").isin(*closing), none) if closing else own, ignorenulls=True).over(running)

    rows = rows.withColumns(
        {
            "_in_chapter": last("chapter", "_line"),
            "_in_section": last("section", "_line", "chapter"),
            "_in_article": last("article", "article_no", "chapter", "section"),
            "_in_paragraph": last("paragraph", "article_no", "chapter", "section", "article"),
        }
    )
    rows = rows.withColumns(
        {
            "_chapter": F.col("_in_chapter.no"),
            "_chapter_at": F.col("_in_chapter.at"),
            "_section": F.col("_in_section.no"),
            "_section_at": F.col("_in_section.at"),
            "_article": F.col("_in_article.no"),
            "_article_at": F.col("_in_article.at"),
            "_paragraph": F.col("_in_paragraph.no"),
            "_paragraph_at": F.col("_in_paragraph.at"),
        }
    )
    kind = F.col("_kind")
    under = F.coalesce("_section_at", "_chapter_at")
    parent = (
        F.when(kind.isin("article", "cn_item"), under)
        .when(kind == "paragraph", F.col("_article_at"))
        .when(kind == "item", F.coalesce("_paragraph_at", "_article_at"))
    )
    full_no = F.when(kind == "whole", F.lit(R.WHOLE_TEXT_FULL_NO)).otherwise(
        F.concat_ws(
            " ",
            "_chapter",
            "_section",
            F.when(kind.isin("paragraph", "item"), F.col("_article")),
            F.when(kind == "item", F.col("_paragraph")),
            F.when(~kind.isin("chapter", "section"), F.col("article_no")),
        )
    )
    path = F.when(kind == "whole", F.lit("")).otherwise(
        F.concat_ws(
            "/",
            "_chapter",
            "_section",
            F.when(~kind.isin("chapter", "section"), F.col("article_no")),
        )
    )
    rows = rows.withColumns(
        {"parent_index": parent, "full_no": full_no, "heading_path": path}
    ).withColumn(
        "_seen",
        F.row_number().over(Window.partitionBy(key, "full_no").orderBy("order_index")),
    )
    return rows.withColumns(
        {
            "full_no": F.when(
                F.col("_seen") > 1, F.concat("full_no", F.lit("（"), "_seen", F.lit("）"))
            ).otherwise(F.col("full_no")),
            "level_code": F.when(kind == "cn_item", F.lit("item"))
            .when(kind == "whole", F.lit("article"))
            .otherwise(kind),
        }
    ).drop(*[c for c in rows.columns if c.startswith("_")])


def knowledge_units(blocks: DataFrame, key: str) -> DataFrame:
    """Citable blocks as answer units with a question hint and a usability score."""
    keep = F.col("level_code").isin("article", "paragraph", "item") & (F.length("content") > 0)
    rows = blocks.filter(keep).withColumn("_body", T.strip(F.col("content")))
    return rows.withColumns(
        {
            "source_no": F.coalesce(F.when(F.col("full_no") != "", F.col("full_no")), "article_no"),
            "question_hint": T.question_hint(F.col("_body"), stripped=True),
            "answer_summary": T.answer_summary(F.col("_body"), stripped=True),
            "usability": T.usability(F.col("_body"), stripped=True),
        }
    ).drop("_body")


def article_tree(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """Depth, root and path of each node, at any depth. A node whose parent is missing is a root; one
    in or below a cycle has neither root nor depth.

    Each round doubles how far up a node sees, so that the joins are logarithmic in the depth. Nodes that
    see a root take no further part as the left side."""
    up = nodes.select(F.col(key).alias("_k"), F.col(parent).alias("_p"))
    known = up.select(F.col("_k").alias("_known"))
    up = up.join(known, F.col("_p") == F.col("_known"), "left")
    rows = up.select(
        F.col("_k").alias(key),
        F.coalesce("_known", "_k").alias("root"),
        F.col("_known").isNotNull().cast("int").alias("depth"),
        F.col("_known").isNull().alias("_done"),
    )
    rows = cut_lineage(rows, "tree")
    for _ in range(rows.count().bit_length() + 1):
        open_rows = rows.filter(~F.col("_done"))
        if open_rows.isEmpty():
            break
        step = rows.select(
            F.col(key).alias("_at"), F.col("root").alias("_root"), F.col("depth").alias("_more"), F.col("_done").alias("_ends")
        )
        moved = open_rows.join(step, F.col("root") == F.col("_at")).select(
            key,
            F.col("_root").alias("root"),
            (F.col("depth") + F.col("_more")).alias("depth"),
            F.col("_ends").alias("_done"),
        )
        rows = cut_lineage(rows.filter("_done").unionByName(moved), "tree")
    return rows.select(key, F.when(F.col("_done"), F.col("root")).alias("root"), F.when(F.col("_done"), F.col("depth")).alias("depth"))
