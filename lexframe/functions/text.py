"""Text operators as Column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions.common import contains_any, extract, first_rule, let, lookup, null_if_empty, text_of
from lexframe.rules import text as R


# ---------------------------------------------------------------- basics


def strip(text: Column) -> Column:
    """Strip Unicode white space, the full-width space included."""
    return F.btrim(text, F.lit(R.SPACE_CHARS))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), R.LINE_BREAK)


def without_space(text: Column) -> Column:
    for char in R.SPACE_SET:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def sentences_of(text: Column) -> Column:
    """Trimmed, non-empty sentences."""
    parts = F.transform(F.split(text_of(text), R.SENTENCE_BREAK), strip)
    return F.filter(parts, lambda s: F.length(s) > 0)


def normalize_brackets(text: Column) -> Column:
    return F.translate(text, "[［]］", "〔〔〕〕")


def blank_to_null(text: Column) -> Column:
    """Null for the literal words that sources write for a missing value."""
    trimmed = F.trim(text)
    return F.when(~F.lower(trimmed).isin(*R.BLANK_VALUES), trimmed)


def clean_date(text: Column) -> Column:
    """Only ``yyyy-MM-dd`` is a date; anything else is null."""
    value = blank_to_null(text)
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def date_from(year: Column, month: Column, day: Column) -> Column:
    """A date from text parts; null when it does not exist."""
    return F.try_to_date(
        F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")),
        "yyyy-MM-dd",
    )


def date_by(text: Column, pattern: str) -> Column:
    return F.when(
        text.rlike(pattern),
        date_from(*[F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]),
    )


def date_in(match: Column, pattern: str) -> Column:
    """The date of a text that `regexp_extract` found by the pattern; null for the empty text of no match."""
    return F.when(match != "", date_from(*[F.regexp_extract(match, pattern, i) for i in (1, 2, 3)]))


def effective_date(text: Column) -> Column:
    return date_by(text, R.EFFECTIVE_DATE)


def repeal_date(text: Column) -> Column:
    return date_by(text, R.REPEAL_DATE)


def normalize_title(title: Column, use: str = "clean") -> Column:
    return F.regexp_replace(text_of(title), R.TITLE_NOISE[use], "")


def normalize_url(url: Column, hosts: tuple[str, str] = R.LISTING_HOST) -> Column:
    return F.replace(F.trim(text_of(url)), F.lit(hosts[0]), F.lit(hosts[1]))


# ---------------------------------------------------------------- regulation header


def _number_line(line: Column) -> Column:
    return (
        line.rlike(R.NUMBER_NEW) | line.rlike(R.NUMBER_BRACKET) | line.rlike(R.NUMBER_ORDER)
    )


def number_places(text: Column) -> tuple[Column, Column]:
    """Line one, and lines one and two joined: where a document has its number."""
    lines = F.split(F.substring_index(strip(text_of(text)), "\n", 2), R.LINE_BREAK, 3)
    one, two = (strip(F.get(lines, F.lit(i))) for i in (0, 1))
    return normalize_brackets(one), normalize_brackets(F.substring(F.concat(one, two), 1, 80))


def number_at(first: Column, joined: Column) -> Column:
    return F.coalesce(F.when(_number_line(first), first), F.when(_number_line(joined), joined))


def document_number(text: Column) -> Column:
    """The number from line one, else from lines one and two joined; null if unknown."""
    return number_at(*number_places(text))


def issuer_of(number: Column) -> Column:
    """Named in the number, or the keeper of its two-character prefix."""
    named = F.trim(F.regexp_replace(extract(number, R.NUMBER_NEW, 1), r"\s+", " "))
    return F.coalesce(
        named,
        F.when(number.rlike(R.NUMBER_BRACKET), lookup(F.substring(number, 1, 2), R.ISSUER_BY_PREFIX)),
        F.when(number.rlike(R.NUMBER_ORDER), F.lit(R.ORDER_ISSUER)),
    )


def issuer_inferred(number: Column) -> Column:
    """Whether the issuer comes from the prefix of a bracket number, and not from its own words."""
    known = lookup(F.substring(number, 1, 2), R.ISSUER_BY_PREFIX).isNotNull()
    return F.coalesce(number.rlike(R.NUMBER_BRACKET) & known & extract(number, R.NUMBER_NEW, 1).isNull(), F.lit(False))


def publish_date(number: Column) -> Column:
    """First of January of the year in the number."""
    year = F.coalesce(extract(number, r"〔(\d{4})〕", 1), extract(number, r"(\d{4})\s*年", 1))
    return date_from(year, F.lit("1"), F.lit("1"))


def hierarchy_by_title(title: Column, issuer: Column) -> Column:
    """Null when no rule holds; the caller applies the default and the review reason."""
    rules = [(level, title.rlike(pattern)) for level, pattern in R.HIERARCHY_BY_TITLE]
    rules.append(("local_normative", contains_any(text_of(issuer), R.LOCAL_ISSUERS)))
    return first_rule(rules)


def title_lines(text: Column) -> Column:
    """The lines among which a title is looked for. They are in the head of the text, and only that is split."""
    return F.transform(F.slice(F.split(F.substring_index(text_of(text), "\n", 6), R.LINE_BREAK, 7), 1, 6), strip)


def title_line(text: Column, number: Column) -> Column:
    """Line one without a number line, else the first title-like line below it."""
    return title_among(title_lines(text), number)


def title_among(lines: Column, number: Column) -> Column:
    first = F.get(lines, F.lit(0))
    filled = F.get(F.filter(lines, lambda s: F.length(s) > 0), F.lit(0))
    heading = "|".join((R.CHAPTER, R.SECTION, R.ARTICLE))
    below = F.filter(
        F.slice(lines, 2, 5),
        lambda s: (F.length(s) > 0)
        & ~s.rlike(heading)
        & F.coalesce(~number.contains(s), F.lit(True)),
    )
    return F.when(
        number.isNotNull() | first.rlike(R.NUMBER_LINE),
        F.coalesce(F.get(below, F.lit(0)), first),
    ).otherwise(F.coalesce(filled, F.lit("")))


def review_reasons(
    number: Column, hierarchy: Column, effective: Column, source_url: Column
) -> Column:
    given = {
        "document_number": number,
        "hierarchy_level": hierarchy,
        "effective_date": effective,
        "source_url": source_url,
    }
    return F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(value.cast("string"), F.lit("")) == "", F.lit(R.REVIEW_REASONS[n]))
                for n, value in given.items()
            ]
        )
    )


def number_in_question(text: Column) -> Column:
    packed = F.regexp_replace(text_of(text), "[ 　]", "")
    return F.coalesce(*[extract(packed, p) for p in R.NUMBER_IN_QUESTION])


def forces_sparse(text: Column) -> Column:
    out = F.lit(False)
    for pattern in R.NUMBER_FORCES_SPARSE:
        out = out | text_of(text).rlike(pattern)
    return out


# ---------------------------------------------------------------- execution windows


def execution_window(text: Column) -> Column:
    """struct(start, end): the stated window with the latest end; the first one on ties."""
    body = text_of(text)

    def parse(part: Column) -> Column:
        digits = [F.regexp_extract(part, R.DATE_PARTS, i) for i in (1, 2, 3)]
        return date_from(*digits)

    found = []
    for pattern in R.WINDOWS:
        starts = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
        ends = F.regexp_extract_all(body, F.lit(pattern), F.lit(2))
        found.append(
            F.zip_with(
                starts, ends, lambda s, e: F.struct(parse(e).alias("end"), parse(s).alias("start"))
            )
        )
    for pattern in R.WINDOW_ENDS:
        ends = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
        found.append(
            F.transform(
                ends,
                lambda e: F.struct(
                    parse(e).alias("end"), F.lit(None).cast("date").alias("start")
                ),
            )
        )
    ranked = F.transform(
        F.concat(*found),
        lambda w, i: F.struct(w["end"].alias("end"), (-i).alias("order"), w["start"].alias("start")),
    )
    best = F.array_max(F.filter(ranked, lambda w: w["end"].isNotNull()))
    return F.struct(best["start"].alias("start"), best["end"].alias("end"))


# ---------------------------------------------------------------- tax types and glossary


def _alternation(words: Sequence[str]) -> str:
    listed = sorted(words, key=len, reverse=True)
    return "|".join("\\Q" + w + "\\E" if not w.isalnum() else w for w in listed)


def detect_names(text: Column, names: Sequence[str] = R.TAX_TYPES) -> Column:
    """Names in the text, longest match first, each once, in order of first position.

    One alternation with longer names first masks a short name inside a long one.
    """
    body = text_of(text)
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(f"({_alternation(names)})"), F.lit(1)))
    placed = F.array_sort(
        F.transform(found, lambda n: F.struct(F.position(n, body).alias("at"), n.alias("n")))
    )
    return F.transform(placed, lambda p: p["n"])


def mask_names(text: Column, names: Sequence[str]) -> Column:
    return F.regexp_replace(text_of(text), f"(?:{_alternation(names)})", " ")


def expand_terms(text: Column, terms: Sequence[tuple] = R.GLOSSARY) -> Column:
    """Append the official word of every colloquial word present, longest word first,
    unless the official word is already there."""
    listed = sorted(terms, key=lambda t: -len(t[0]))
    added = F.array_compact(
        F.array(
            *[
                F.when(text.contains(alias) & ~text.contains(official), F.lit(official))
                for alias, official, _ in listed
            ]
        )
    )
    return F.when(F.size(added) > 0, F.concat_ws(" ", text, F.array_join(added, " "))).otherwise(text)


def names_with_aliases(
    text: Column, names: Sequence[str] = R.TAX_TYPES, terms: Sequence[tuple] = R.GLOSSARY
) -> Column:
    """Full names first; aliases only in what is left after masking the full names."""
    return _with_aliases(detect_names(text, names), mask_names(text, names), terms)


def _with_aliases(full: Column, rest: Column, terms: Sequence[tuple]) -> Column:
    by_alias = [
        F.when(rest.contains(alias), F.array(*[F.lit(t) for t in types])).otherwise(
            F.array().cast("array<string>")
        )
        for alias, _, types in sorted(terms, key=lambda t: -len(t[0]))
        if types
    ]
    return F.array_distinct(F.concat(full, *by_alias))


def names_from_category(category: Column, names: Sequence[str] = R.TAX_TYPES) -> Column:
    """Known names in the last segment of an official category text, in text order."""
    tail = F.trim(F.element_at(F.split(text_of(category), "-"), -1))
    parts = F.filter(
        F.transform(F.split(tail, "[、,，/和及]"), lambda p: F.trim(p)), lambda p: F.length(p) > 0
    )
    listed = F.array(*[F.lit(n) for n in names])
    hits = F.transform(parts, lambda p: F.get(F.filter(listed, lambda n: p.contains(n)), F.lit(0)))
    return F.array_distinct(F.array_compact(hits))


def body_names(text: Column, names: Sequence[str] = R.TAX_TYPES, at_least: int = 2, top: int = 2) -> Column:
    """The most frequent names of the body, each at least twice, at most two."""
    body = text_of(text)
    counted = F.array(
        *[
            F.struct(
                (-_occurrences(body, n)).alias("neg"),
                F.position(F.lit(n), body).alias("at"),
                F.lit(n).alias("name"),
            )
            for n in names
        ]
    )
    detected = detect_names(text, names)
    kept = F.filter(
        counted, lambda c: (c["neg"] <= -at_least) & F.array_contains(detected, c["name"])
    )
    return F.transform(F.slice(F.array_sort(kept), 1, top), lambda c: c["name"])


def _occurrences(text: Column, word: str) -> Column:
    """Count of non-overlapping occurrences."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))
    return (gone / F.lit(len(word))).cast("int")


def infer_names(
    explicit: Column,
    category: Column,
    collection: Column,
    title: Column,
    body: Column,
    names: Sequence[str] = R.TAX_TYPES,
    collections: Mapping[str, str] = R.COLLECTION_TAX,
) -> Column:
    """Explicit, else official plus title, else collection, else title (3), else body."""

    def filled(array: Column) -> Column:
        return F.when(F.size(array) > 0, array)

    official = names_from_category(category, names)
    titled = detect_names(title, names)
    by_collection = lookup(collection, collections)
    return F.coalesce(
        filled(F.filter(explicit, lambda n: F.length(n) > 0)),
        F.when(F.size(official) > 0, F.array_union(official, titled)),
        F.when(by_collection.isNotNull(), F.array(by_collection)),
        filled(F.slice(titled, 1, 3)),
        body_names(body, names),
    )


# ---------------------------------------------------------------- cleaning


def clean_noise(
    text: Column,
    line_patterns: Sequence[str] = R.NOISE_LINES,
    tag_pattern: str = R.NOISE_TAG,
    inline_pattern: str = R.NOISE_INLINE,
) -> Column:
    """Drop noise lines, cut a line at its first noise word, squeeze blank lines."""
    drop = "|".join(f"(?:{p})" for p in (tag_pattern, *line_patterns))
    lines = F.transform(lines_of(text), strip)
    kept = F.filter(lines, lambda s: (F.length(s) == 0) | ~s.rlike(drop))
    cut = F.transform(
        kept,
        lambda s: F.when(
            s.rlike(inline_pattern),
            F.concat(F.lit("\x00"), strip(F.regexp_replace(s, f"(?:{inline_pattern}).*$", ""))),
        ).otherwise(s),
    )
    left = F.transform(
        F.filter(cut, lambda s: s != F.lit("\x00")), lambda s: F.replace(s, F.lit("\x00"), F.lit(""))
    )
    return strip(F.regexp_replace(F.array_join(left, "\n"), r"\n{3,}", "\n\n"))


def attachment_only(text: Column, hint: str = R.ATTACHMENT_HINT, clause: str = R.CLAUSE_MARK) -> Column:
    return (
        (F.length(text) <= R.ATTACHMENT_ONLY_CHARS) & text.rlike(hint) & ~text.rlike(clause)
    )


def is_truncated(text: Column) -> Column:
    return text.contains(R.TRUNCATED_MARK) | F.rtrim(text).endswith(R.TRUNCATED_END)


# ---------------------------------------------------------------- html


# Character references that occur in pages.
ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&mdash;", "—"),
    ("&middot;", "·"),
    ("&hellip;", "…"),
    ("&times;", "×"),
    ("&emsp;", " "),
    ("&ensp;", " "),
    ("&amp;", "&"),
)


def unescape(text: Column) -> Column:
    """Character references to characters; the ampersand last, so nothing decodes twice."""
    out = text
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def html_to_text(html: Column) -> Column:
    body = F.regexp_replace(text_of(html), r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    body = F.regexp_replace(body, r"(?i)</p\s*>|<br\s*/?>|</div\s*>", "\n")
    body = unescape(F.regexp_replace(body, r"<[^>]+>", ""))
    body = F.regexp_replace(F.translate(body, "　 ", "  "), "​", "")
    lines = F.filter(F.transform(lines_of(body), strip), lambda s: F.length(s) > 0)
    return F.array_join(lines, "\n")


def pick(html: Column, pattern: str, group: int = 1) -> Column:
    """First match without tags, unescaped and trimmed; null when absent or empty."""
    found = F.regexp_extract(html, f"(?s){pattern}", group)
    return null_if_empty(strip(unescape(F.regexp_replace(found, r"<[^>]+>", ""))))


# Places of the fields on a detail page.
PAGE_FIELDS = {
    "title": (r"<h3[^>]*>(.*?)</h3>", r'<meta name="ArticleTitle" content="([^"]*)"'),
    "document_number": (
        r'<div class="arctips">\s*<h5[^>]*>(.*?)</h5>',
        r'<h5 class="actfwzh"[^>]*>(.*?)</h5>',
    ),
    "written_date": (
        r'<span class="date"[^>]*>.*?成文日期[:：]\s*([0-9]{4}-[0-9]{2}-[0-9]{2})',
    ),
}
PAGE_BODY = (
    r'<div class="arc_cont">(.*?)</div>\s*</div>',
    r'<div class="arc_cont">(.*?)(?:<div class="|</body>)',
)
PAGE_NOTE = (r'<div class="zscont">(.*?)</div>',)


def page_fields(
    html: Column,
    fields: Mapping[str, Sequence[str]] = PAGE_FIELDS,
    body: Sequence[str] = PAGE_BODY,
    note: Sequence[str] = PAGE_NOTE,
) -> dict[str, Column]:
    """Fields of a detail page, each by its first pattern that matches."""
    out = {n: F.coalesce(*[pick(html, p) for p in ps]) for n, ps in fields.items()}
    for name, patterns in (("body", body), ("note", note)):
        raw = F.coalesce(*[extract(html, f"(?s){p}", 1) for p in patterns])
        out[name] = html_to_text(raw)
    out["effective_date"] = effective_date(F.concat(out["note"], out["body"]))
    out["official_status"] = extract(html, R.STATUS_BADGE, 1)
    return out


def absolute_url(href: Column, page_url: Column) -> Column:
    """A link resolved against its page: absolute, scheme-relative, rooted, or relative."""
    root = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1)
    path = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^?#]*)", 1)
    folder = F.regexp_replace(path, r"(?<=[^/:])/[^/]*$", "")
    clean = F.regexp_replace(href, r"^(?:\./)+", "")
    return (
        F.when(href.rlike("(?i)^https?:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page_url, r"^([a-zA-Z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, F.lit("/"), clean))
    )


def attachment_links(html: Column, page_url: Column, pattern: str = R.ATTACHMENT_LINK) -> Column:
    links = F.transform(
        F.regexp_extract_all(text_of(html), F.lit(pattern), F.lit(1)), lambda h: F.trim(h)
    )
    usable = F.filter(
        links, lambda h: (F.length(h) > 0) & ~F.lower(h).startswith("javascript:")
    )
    return F.array_distinct(F.transform(usable, lambda h: absolute_url(h, page_url)))


# ---------------------------------------------------------------- scores


def usability(
    text: Column,
    vague: Sequence[str] = R.VAGUE_PHRASES,
    concrete: Sequence[str] = R.CONCRETE,
    stripped: bool = False,
) -> Column:
    """`stripped` says that the text is a column without white space around it, which need not be stripped again."""
    body = text if stripped else strip(text_of(text))
    n = F.length(body)
    is_concrete = body.rlike("|".join(f"(?:{pattern})" for pattern in concrete)) if concrete else F.lit(False)
    score = (
        F.lit(0.4)
        + F.when(is_concrete, 0.3).otherwise(0.0)
        + F.when(n.between(15, 200), 0.2).when(n > 400, -0.1).otherwise(0.0)
    )
    return (
        F.when(n == 0, 0.0)
        .when(contains_any(body, vague), 0.1)
        .otherwise(F.round(F.least(score, F.lit(1.0)), 2))
    )


def question_hint(text: Column, stripped: bool = False) -> Column:
    body = text if stripped else strip(text_of(text))
    head = F.substring(body, 1, 20)
    out = F.when(F.length(body) == 0, F.lit(""))
    for words, tail in R.QUESTION_HINTS:
        out = out.when(contains_any(body, words), F.concat(head, F.lit(tail)))
    return out.otherwise(F.concat(head, F.lit(R.QUESTION_HINT_DEFAULT)))


def answer_summary(text: Column, stripped: bool = False) -> Column:
    first = F.get(F.split(text if stripped else strip(text_of(text)), "[。；;]", 2), F.lit(0))
    return F.when(F.length(first) <= 120, first).otherwise(
        F.concat(F.substring(first, 1, 117), F.lit("…"))
    )


def substance(
    text: Column,
    ratio: str = R.RATIO,
    limit_words: Sequence[str] = R.LIMIT_WORDS,
    limit_money: str = R.LIMIT_MONEY,
    strong: str = R.STRONG_BENEFIT,
    soft: Sequence[str] = R.SOFT_BENEFIT,
) -> Column:
    """How much hard benefit a text states: ratios, limits in money, strong and soft words."""
    body = text_of(text)
    soft_hits = F.lit(0)
    for word in soft:
        soft_hits = soft_hits + body.contains(word).cast("int")
    limit = contains_any(body, limit_words) & body.rlike(limit_money)
    return (
        F.regexp_count(body, F.lit(ratio)) * 10
        + F.when(limit, 6).otherwise(0)
        + F.regexp_count(body, F.lit(strong)) * 5
        + soft_hits
    )


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text_of(text), rf"{R.SPACE}+", " "))


def best_sentence(text: Column, limit: int = R.POINT_CHARS, score=substance) -> Column:
    """The sentence of most substance, the first one on ties, cut to the limit."""
    marked = squeeze(text)
    for mark in "。；;":
        marked = F.replace(marked, F.lit(mark), F.lit(mark + "\n"))
    parts = F.filter(F.transform(F.split(marked, "\n"), strip), lambda s: F.length(s) > 0)

    def best(parts: Column) -> Column:
        rated = F.transform(
            parts, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("order"), s.alias("s"))
        )
        return F.when(F.size(parts) == 0, F.lit("")).otherwise(let(F.array_max(rated)["s"], lambda s: cut(s, limit)))

    return let(parts, best)


def cut(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def first_sentence(text: Column, limit: int = R.FIRST_SENTENCE_CHARS) -> Column:
    """Up to the first mark that ends a sentence of useful length within the limit."""
    body = squeeze(text)
    out = F.when(F.length(body) == 0, F.lit(""))
    for mark in ("。", "；", ";"):
        at = F.position(F.lit(mark), body)
        out = out.when(
            (at > 1) & (at <= limit + 1) & (at >= R.MIN_POINT_CHARS),
            F.substring(body, F.lit(1), at),
        )
    return out.otherwise(cut(body, limit))


# ---------------------------------------------------------------- intents, phrases


def question_intent(text: Column, rules: Sequence = R.QUESTION_INTENTS, default: str = R.DEFAULT_INTENT) -> Column:
    body = text_of(text)
    return first_rule([(name, contains_any(body, words)) for name, words in rules], default)


def first_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """Text of the first pattern, in rule order, that matches; null for none."""
    return F.coalesce(*[extract(text, p) for p in patterns])


def red_lines(text: Column, rules: Sequence) -> Column:
    """array<struct(code, name, matched, alternative)>, one entry per red line."""
    hits = []
    for code, name, patterns, alternative in rules:
        found = first_pattern(text_of(text), patterns)
        hits.append(
            F.when(
                found.isNotNull(),
                F.struct(
                    F.lit(code).alias("code"),
                    F.lit(name).alias("name"),
                    found.alias("matched"),
                    F.lit(alternative).alias("alternative"),
                ),
            )
        )
    return F.array_compact(F.array(*hits))


def overreach(text: Column, rules: Sequence = R.OVERREACH) -> Column:
    """array<struct(code, matched)> of phrases an answer must not use."""
    hits = []
    for code, pattern in rules:
        found = extract(text_of(text), pattern)
        hits.append(
            F.when(found.isNotNull(), F.struct(F.lit(code).alias("code"), found.alias("matched")))
        )
    return F.array_compact(F.array(*hits))


def disclaimer_issue(disclaimer: Column, words: Sequence[str] = R.DISCLAIMER_WORDS) -> Column:
    return F.when(disclaimer.isNull(), F.lit("disclaimer_missing")).when(
        ~contains_any(disclaimer, words), F.lit("disclaimer_incomplete")
    )


def add_gap_topic(
    df: DataFrame,
    text: str = "question",
    names: Sequence[str] = R.TAX_TYPES,
    terms: Sequence[tuple] = R.GLOSSARY,
    words: Sequence[str] = R.TOPIC_WORDS,
) -> DataFrame:
    """Adds topic and tax_type of a question. The parts are columns of their own, so each
    is computed once per row."""
    body = text_of(text)
    rows = df.withColumns(
        {
            "_full": detect_names(body, names),
            "_rest": mask_names(body, names),
            "_word": first_rule([(w, body.contains(w)) for w in words]),
        }
    ).withColumn("tax_type", F.get(_with_aliases(F.col("_full"), F.col("_rest"), terms), F.lit(0)))
    tax, word = F.col("tax_type"), F.col("_word")
    topic = (
        F.when(tax.isNotNull() & word.isNotNull(), F.concat_ws("·", tax, word))
        .when(tax.isNotNull(), tax)
        .when(word.isNotNull(), F.concat_ws("·", F.lit(R.TOPIC_NO_TAX), word))
        .otherwise(F.lit(R.TOPIC_NONE))
    )
    return rows.withColumn("topic", topic).drop("_full", "_rest", "_word")


def parse_citation(text: Column) -> Column:
    """struct(document_number, regulation_title, full_no) of a citation text."""
    clean = strip(text_of(text))
    numbered = clean.rlike(R.CITATION_NUMBER)
    head = F.regexp_extract(clean, r"(?s)^(.+) (第[^ ]*)$", 1)
    tail = F.regexp_extract(clean, r"(?s)^(.+) (第[^ ]*)$", 2)
    split = F.length(tail) > 0
    return F.struct(
        F.when(numbered, clean).alias("document_number"),
        F.when(~numbered, F.when(split, head).otherwise(clean)).alias("regulation_title"),
        F.when(~numbered & split, tail).alias("full_no"),
    )


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters, white space removed."""
    chars = F.split(without_space(text_of(text)), "")
    n = F.size(chars)
    runs = F.arrays_zip(
        F.slice(chars, 1, F.greatest(n - 2, F.lit(0))),
        F.slice(chars, 2, F.greatest(n - 2, F.lit(0))),
        F.slice(chars, 3, F.greatest(n - 2, F.lit(0))),
    )
    return F.array_distinct(F.transform(runs, lambda r: F.concat(r["0"], r["1"], r["2"])))


def trigram_containment(left: Column, right: Column) -> Column:
    """Share of the left trigrams that the right text has; 1.0 for an empty left."""
    return containment(trigrams(left), right)


def containment(mine: Column, right: Column) -> Column:
    """The same for trigrams that are there already."""
    return F.when(F.size(mine) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(mine, trigrams(right))) / F.size(mine)
    )
