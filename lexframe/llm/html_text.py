"""Main text of web pages, with templates of a site removed.

A page is read into elements (unclosed and misnested tags are closed as browsers do). The subtree of
an element is hashed: tag, class, text and the hashes of its children. Spark counts for each host
on how many pages a subtree occurs. Only containers can be templates (`CONTAINERS`): a word, a heading,
a paragraph, a list item or a table cell that recurs is never deleted on its own, and neither are
lists and tables that stand among paragraphs. A container that occurs outside of `article` and `main` on `PAGES`
pages that are no copies of each other is a template, however large the host is, and is deleted
wherever that host has it outside of them. Inside them a template is what occurs on `SHARE` of a
host's pages, and on `PAGES` at least.

Elements that are menus, headers, footers, sidebars, notices, adverts, forms or reader comments by tag, role,
id or class are deleted on every page, unless they hold half of the text of its `article` and `main`
elements: those are layouts, and only what is in them is judged. On a page without either, names and forms do
not delete what holds half of the text of its paragraphs. Scripts, styles and the like always go.

The text is that of `main`, or else of the whole body; where the articles in it hold half of its text,
that of the articles. Blocks are cut at block tags.

Subtrees meet the templates by (host, subtree), so that a task never holds a host's templates together;
a page gets those that it has itself.

Defined cases: a null html is empty and has an empty text; a url without a host (or null) has no
templates; repeated rows are one page more each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.base import cut_lineage, register, table, whole

SHARE, PAGES = 0.5, 10

#: Tags by what they do, and names that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROP = frozenset("script style noscript template nav header footer aside form iframe svg button select textarea head title menu dialog object canvas".split())
ALWAYS = frozenset("script style noscript template head title svg iframe object canvas button select textarea".split())
CONTAINERS = frozenset("div section aside nav header footer form menu fieldset details address".split())
LISTS = frozenset("ul ol dl table figure".split())
RUNNING = frozenset("p blockquote pre".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|notice|cookies?|consent|gdpr|banner|ads?|advert|adverts|advertisement"
    r"|advertising|sponsor|sponsored|promo|comments?|respond|replies|disqus|share|sharing|social|related|breadcrumbs?|newsletter|subscribe|popup|modal|pagination)(?=$|[\s_-])",
    re.I,
)
#: Open tags that the start of a tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article main section div aside nav header footer body ul ol dl table form".split())


class Page(HTMLParser):
    """Elements of a page in order of their starts, and pieces of text with their elements."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.marked = ["#page"], [-1], [False]
        self.always, self.byname, self.chars, self.flows = [False], [False], [0], [False]
        self.roots = {"article": [], "main": []}
        self.hashes = [hashlib.blake2b(digest_size=8)]
        self.digests: list[int | None] = [None]
        self.pieces: list[tuple[int, str | None]] = []
        self.open = [0]
        self.feed(html)
        self.close()
        while self.open:
            self._pop()

    def _pop(self) -> None:
        i = self.open.pop()
        digest = self.hashes[i].digest()
        self.hashes[i] = None
        self.digests[i] = int.from_bytes(digest, "little", signed=True)
        if self.open:
            self.hashes[self.open[-1]].update(b"\x01" + digest)

    def _close(self, tags, scopes=SCOPES) -> None:
        """Closes the innermost open element of `tags`, unless a scope lies between."""
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[depth]]
            if tag in tags:
                while len(self.open) > depth:
                    self._pop()
                return
            if tag in scopes:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._close({"p"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES - {"tr"} if tag == "tr" else SCOPES)
        parent, given = self.open[-1], {k: v or "" for k, v in attrs}
        if tag in BLOCK or tag == "br":
            self.pieces.append((parent, None if tag in BLOCK else " "))
        if tag in VOID:
            self.hashes[parent].update(f"\x02{tag}".encode())
            return
        own = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        names = f"{given.get('class', '')} {given.get('id', '')}"
        kind = tag in DROP or given.get("role", "").lower() in ROLES or "hidden" in given
        # An article is a comment or an advert by a whole name only, as in "post comments-open".
        named = any(NAMES.fullmatch(name) for name in names.split()) if tag == "article" else bool(NAMES.search(names))
        self.marked.append(kind or (named and tag not in ("html", "body", "main")))
        self.byname.append(tag == "form" or not kind)
        self.always.append(tag in ALWAYS)
        self.chars.append(0)
        self.flows.append(False)
        self.flows[parent] = self.flows[parent] or tag in RUNNING
        if tag in self.roots or given.get("role") == "main":
            self.roots["article" if tag == "article" else "main"].append(own)
        self.hashes.append(hashlib.blake2b(f"{tag}\x03{given.get('class', '')}".encode("utf-8", "replace"), digest_size=8))
        self.digests.append(None)
        self.open.append(own)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.pieces.append((self.open[-1], " "))
            return
        self._close({tag}, frozenset() if tag in SCOPES else SCOPES - {tag})
        if tag in BLOCK:
            self.pieces.append((self.open[-1], None))

    def handle_data(self, data):
        own = self.open[-1]
        self.pieces.append((own, data))
        text = " ".join(data.split())
        self.chars[own] += 0 if self.always[own] else len(text)
        if text:
            self.hashes[own].update(b"\x04" + text.encode("utf-8", "replace"))

    def inside(self, roots: list[int]) -> list[bool]:
        found, wanted = [], set(roots)
        for i, parent in enumerate(self.parents):
            found.append(i in wanted or (parent >= 0 and found[parent]))
        return found

    def holding(self, wanted: list[int]) -> list[bool]:
        found = [False] * len(self.tags)
        for i in wanted:
            while i >= 0 and not found[i]:
                found[i] = True
                i = self.parents[i]
        return found

    def places(self) -> tuple[list[bool], list[bool]]:
        """For each element: whether it may be a template, and whether it stands outside of article and main."""
        roots = self.roots["article"] + self.roots["main"]
        content, holds_root = self.inside(roots), self.holding(roots)
        may = []
        for i, tag in enumerate(self.tags):
            kind = tag in CONTAINERS or (tag in LISTS and not self.flows[self.parents[i]])
            may.append(bool(i) and kind and not holds_root[i])
        return may, [not inside for inside in content]

    def share(self, wanted: list[int]) -> list[bool]:
        """Whether each element holds half of the text that stands inside of the wanted ones."""
        sums = [n if inside else 0 for n, inside in zip(self.chars, self.inside(wanted), strict=True)]
        for i in range(len(sums) - 1, 0, -1):
            sums[self.parents[i]] += sums[i]
        return [2 * n >= sums[0] > 0 for n in sums]

    def dropped(self) -> list[bool]:
        """The elements that go by their tag, role or names."""
        roots = self.roots["article"] + self.roots["main"]
        articles = set(self.roots["article"])
        # Names and forms may be those of a layout; without an article its paragraphs show it.
        layout = self.share(roots or [i for i, tag in enumerate(self.tags) if tag in RUNNING])
        out = []
        for i, (marked, most) in enumerate(zip(self.marked, layout, strict=True)):
            keep = most and i not in articles and (bool(roots) or self.byname[i])
            out.append(self.always[i] or (marked and not keep))
        return out

    def candidates(self) -> dict[int, bool]:
        """Hashes of the subtrees that may be templates, and whether they occur outside of article and main."""
        found: dict[int, bool] = {}
        for digest, may, outside in zip(self.digests, *self.places(), strict=True):
            if may:
                found[digest] = found.get(digest, False) or outside
        return found

    def text(self, templates: dict[int, bool]) -> str:
        """The main text; `templates` says of each whether it goes everywhere, or only outside of article and main."""
        gone = []
        for i, (drop, may, outside) in enumerate(zip(self.dropped(), *self.places(), strict=True)):
            template = may and self.digests[i] in templates and (outside or templates[self.digests[i]])
            gone.append((i > 0 and gone[self.parents[i]]) or drop or template)
        held = [0] * len(self.tags)
        for own, piece in self.pieces:
            if piece and not gone[own]:
                held[own] += len(piece.strip())

        def amount(roots: list[int]) -> int:
            return sum(n for n, inside in zip(held, self.inside(roots), strict=True) if inside)

        live = {k: [i for i in v if not gone[i]] for k, v in self.roots.items()}
        scope = live["main"] if amount(live["main"]) else [0]
        within = self.inside(scope)
        articles = [i for i in live["article"] if within[i]]
        inside = self.inside(articles) if articles and 2 * amount(articles) >= amount(scope) else within
        blocks, block = [], []
        for own, piece in [*self.pieces, (0, None)]:
            if piece is None or not inside[own]:
                words = "".join(block).split()
                block = []
                if words:
                    blocks.append(" ".join(words))
            elif not gone[own]:
                block.append(piece)
        return "\n\n".join(blocks)


def _subtrees(batches):
    for batch in batches:
        keys, hosts, found, outside = [], [], [], []
        for key, host, html in zip(*(batch.column(c).to_pylist() for c in ("key", "host", "html")), strict=True):
            page = Page(html)
            own = sorted(page.candidates().items()) if host else []
            keys += [key] * len(own)
            hosts += [host] * len(own)
            found += [d for d, _ in own]
            outside += [page.digests[0] if o else None for _, o in own]
        columns = [pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(outside, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "host", "subtree", "outside"])


def _texts(batches):
    for batch in batches:
        texts = []
        for html, templates in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist(), strict=True):
            texts.append(Page(html).text({t["subtree"]: t["everywhere"] for t in templates or ()}))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url="url"):
    found = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def _rows(pages: DataFrame) -> DataFrame:
    key = F.xxhash64("page_id", "url", whole("html"))
    return pages.select("page_id", "url", whole("html").alias("html"), host_of().alias("host"), key.alias("key"))


def _found(pages: DataFrame) -> DataFrame:
    rows = _rows(pages).where("host IS NOT NULL").select("key", "host", "html")
    return rows.mapInArrow(_subtrees, "key long, host string, subtree long, outside long")


def site_templates(pages: DataFrame, found: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """(host, subtree, everywhere): subtrees on at least `least` different pages outside of article and main, or on
    at least `share` of the host's; only these go everywhere. `found` has the subtrees of the pages."""
    totals = _rows(pages).where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    counts = found.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("outside").alias("n_outside"))
    many = counts.where(F.col("n") >= least).join(totals.hint("merge"), "host").withColumn("everywhere", F.col("n") >= F.col("pages") * share)
    return many.where(F.col("everywhere") | (F.col("n_outside") >= least)).select("host", "subtree", "everywhere")


def extract(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """page_id, url and text of every page."""
    found = cut_lineage(_found(pages), "subtrees")
    templates = cut_lineage(site_templates(pages, found, share, least), "templates")
    # Both sides of either join grow with the pages; none is ever broadcast.
    own = found.select("key", "host", "subtree").join(templates.hint("merge"), ["host", "subtree"])
    own = own.groupBy("key").agg(F.collect_set(F.struct("subtree", "everywhere")).alias("templates"))
    rows = _rows(pages).join(own.hint("merge"), "key", "left")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return rows.select("page_id", "url", "html", "templates").mapInArrow(_texts, f"page_id {kinds['page_id']}, url string, text string")


@register("op6_html_extraction")
def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
