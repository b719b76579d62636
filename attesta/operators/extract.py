"""Extraction jobs over a page table, and the contract for user parsers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.functions import urls as U

_NOISE = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"


def text_of(markup: Column) -> Column:
    """Visible text of a piece of markup, cleaned."""
    bare = F.regexp_replace(F.regexp_replace(markup, _NOISE, " "), r"(?s)<[^>]*>", " ")
    return X.clean(X.unescape(bare))


def attribute(tag: Column, name: str) -> Column:
    """Attribute of an opening tag, null when absent."""
    value = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([\"'])(.*?)\1", 2)
    bare = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([^\s\"'>]+)", 1)
    quoted = F.regexp(tag, F.lit(rf"(?i)\s{name}\s*=\s*[\"']"))
    return F.when(F.regexp(tag, F.lit(rf"(?i)\s{name}\s*=")),
                  X.unescape(F.when(quoted, value).otherwise(bare)))


def extract_anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every anchor of every page: page_id, pos, href, title, text, slug. JVM only."""
    found = F.regexp_extract_all(F.regexp_replace(html, _NOISE, " "),
                                 F.lit(r"(?is)<a\s[^>]*>.*?</a\s*>"), F.lit(0))
    kept = [c for c in pages.columns if c != html]

    def parts(anchor: Column) -> Column:
        opening = F.regexp_extract(anchor, r"(?s)^<[^>]*>", 0)
        title = X.clean(F.coalesce(attribute(opening, "title"), F.lit("")))
        return F.struct(attribute(opening, "href").alias("href"), title.alias("title"),
                        text_of(anchor).alias("text"))

    # The generator settles the parts: filters and later steps do not work them out again.
    rows = pages.select(*kept, F.posexplode(F.transform(found, parts)).alias("pos", "_a"))
    return rows.select(*kept, "pos", "_a.*").withColumn(
        "slug", X.last_segment(F.coalesce("href", F.lit(""))))


def first_title(anchors: DataFrame, title: str = "title", page: str = "page_id") -> DataFrame:
    """First non-empty title per (page, slug); a slug that never has one keeps a null."""
    named = F.when(F.col(title) != "", F.col("pos"))
    return anchors.filter(F.col("slug") != "").groupBy(page, "slug").agg(
        F.min_by(title, named).alias("name"), F.min("pos").alias("pos"))


# --- page helper for parsers -------------------------------------------------------------

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
         "source", "track", "wbr"}
# Which open elements a start tag ends when their end tag was left out, and where to stop looking.
_ROWS = {"tr", "td", "th"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
         "optgroup": {"option", "optgroup"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": _ROWS,
         "thead": _ROWS, "tbody": _ROWS | {"thead", "tbody"}, "tfoot": _ROWS | {"thead", "tbody"}}
_ENDS.update(dict.fromkeys(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split(), {"p"}))
_INSIDE = {"root", "ul", "ol", "menu", "dl", "table", "select", "div", "section", "article", "main",
           "button", "td", "th", "caption"}


@dataclass
class Element:
    """One element of a page, as user parsers see it."""
    tag: str
    attrs: dict
    children: list = field(default_factory=list)
    parent: Element | None = field(default=None, repr=False, compare=False)

    def closest(self, tag: str | None = None, cls: str | None = None) -> Element | None:
        """The nearest element around this one, itself included, with the tag and class."""
        found = self
        while found is not None and not (
                (tag is None or found.tag == tag)
                and (cls is None or cls in found.attrs.get("class", "").split())):
            found = found.parent
        return found

    def text(self) -> str:
        parts, waiting = [], list(reversed(self.children))
        while waiting:
            child = waiting.pop()
            if isinstance(child, str):
                parts.append(child)
            else:
                waiting.extend(reversed(child.children))
        return " ".join("".join(parts).split())

    def all(self, tag: str | None = None, cls: str | None = None) -> Iterator[Element]:
        waiting = list(reversed(self.children))
        while waiting:
            child = waiting.pop()
            if isinstance(child, Element):
                named = tag is None or child.tag == tag
                if named and (cls is None or cls in child.attrs.get("class", "").split()):
                    yield child
                waiting.extend(reversed(child.children))

    def first(self, tag: str | None = None, cls: str | None = None) -> Element | None:
        return next(self.all(tag, cls), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Element("root", {})]

    def handle_starttag(self, tag, attrs):
        element = Element(tag, {k: v or "" for k, v in attrs})
        if tag in _ENDS:
            self._end_implied(tag)
        element.parent = self.open[-1]
        self.open[-1].children.append(element)
        if tag not in _VOID:
            self.open.append(element)

    def _end_implied(self, tag):
        ended, stop = _ENDS[tag], _INSIDE - _ENDS[tag]
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in stop:
                return
            if self.open[depth].tag in ended:
                del self.open[depth:]
                if tag not in ("tr", "thead", "tbody", "tfoot"):
                    return

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].children.append(data)


def parse_html(html: str) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.open[0]


#: Rows that a task hands on together.
PIECE_ROWS = 1000


def _in_pieces(batches: Iterator[pd.DataFrame], rows_of: Callable, names: list[str],
               types: Mapping[str, str] | None = None) -> Iterator[pd.DataFrame]:
    """The rows that `rows_of` gives for each page of the batches, a bounded number at a time, so
    that a task never holds the rows of a whole batch."""
    for batch in batches:
        rows = (row for page in zip(*(batch[c] for c in batch.columns)) for row in rows_of(*page))
        while piece := list(islice(rows, PIECE_ROWS)):
            yield pd.DataFrame(piece, columns=names).astype(types or {})


def _parsed(html: str) -> Iterator[Element]:
    """A page while it is looked at. Elements and their parents refer to each other, and such trees
    would pile up until Python's collector runs: they are taken apart behind the last row."""
    page = parse_html(html)
    yield page
    waiting = [page]
    while waiting:
        element = waiting.pop()
        waiting.extend(c for c in element.children if isinstance(c, Element))
        element.parent, element.children = None, []


# --- user parsers ------------------------------------------------------------------------

Parser = Callable[[str, str], tuple[dict[str, list[dict]], list[str]]]


@dataclass(frozen=True)
class SiteParser:
    """A pure parser `(url, html) -> ({entity_type: [record]}, [warning])` with the site it
    belongs to and the row counts a full run of it should give.

    The function travels to the executors by value: let it import the names it uses, such as
    `parse_html`, rather than refer to a module of this package."""
    name: str
    site: str
    parse: Parser
    expectations: Mapping[str, tuple[int, int]] = field(default_factory=dict)


class ParserRegistry:
    def __init__(self, *parsers: SiteParser):
        self.parsers: dict[str, SiteParser] = {}
        for parser in parsers:
            self.register(parser)

    def register(self, parser: SiteParser) -> SiteParser:
        if parser.name in self.parsers:
            raise ValueError(f"parser {parser.name!r} is already registered")
        self.parsers[parser.name] = parser
        return parser

    def expectations(self, spark) -> DataFrame:
        rows = [(p.site, kind, low, high) for p in self.parsers.values()
                for kind, (low, high) in p.expectations.items()]
        return spark.createDataFrame(
            rows, "owner string, entity_type string, min_rows int, max_rows int")


def discover(sites: DataFrame, slugs: DataFrame, pattern: str) -> DataFrame:
    """Enumerate source refs: every slug under its site's origin, by a `{origin}/{slug}`
    pattern. `slugs` carries the site it belongs to."""
    url = F.lit(pattern)
    joined = slugs.join(sites.select("site", "origin"), "site")
    for name in ("origin", "slug"):
        url = F.replace(url, F.lit("{" + name + "}"), F.col(name))
    return joined.withColumn("url", url)


def route(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """Name the parser of each page: the first rule whose pattern its path matches."""
    path = F.regexp_replace(U.path_and_query(F.col(url)), r"\?.*$", "")
    named = F.lit(None).cast("string")
    for pattern, parser in reversed(list(rules)):
        named = F.when(F.regexp(path, F.lit(pattern)), parser).otherwise(named)
    return pages.withColumn("parser", named)


def extract_records(pages: DataFrame, rules: Sequence[tuple[str, str]],
                    registry: ParserRegistry) -> DataFrame:
    """Run each page through its parser: page_id, parser, entity_type, pos, record (JSON),
    warning. A page without a rule, or whose parser raises, gives one warning row.

    Pages stay in their scan partitions; bodies are not shuffled.
    """
    known = {name: parser.parse for name, parser in registry.parsers.items()}
    missing = {parser for _, parser in rules} - set(known)
    if missing:
        raise ValueError(f"rules name unknown parsers: {sorted(missing)}")

    def rows_of(page_id, url, html, name) -> Iterator[tuple]:
        if name is None:
            yield page_id, None, None, None, None, f"no parser for {url}"
            return
        try:
            by_entity, warnings = known[name](url, html)
        except Exception as error:  # a user parser's failure is data, not a crash
            yield page_id, name, None, None, None, f"parse failed: {error}"
            return
        for kind, records in by_entity.items():
            for i, r in enumerate(records):
                yield (page_id, name, kind, i,
                       json.dumps(r, ensure_ascii=False, sort_keys=True), None)
        for w in warnings:
            yield page_id, name, None, None, None, w

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _in_pieces(batches, rows_of, ["page_id", "parser", "entity_type", "pos", "record",
                                             "warning"], {"pos": "Int32"})

    id_type = pages.schema["page_id"].dataType.simpleString()
    return route(pages, rules).select("page_id", "url", "html", "parser").mapInPandas(
        run, f"page_id {id_type}, parser string, entity_type string, pos int, record string, "
             "warning string")


# --- element rows ------------------------------------------------------------------------

@dataclass(frozen=True)
class CardSpec:
    """Where a repeated card keeps its parts, as (tag, class) pairs; class may be None.

    Without a title part, the text of the whole card is its title."""
    card: tuple[str, str | None]
    title: tuple[str, str | None] | None = None
    link: tuple[str, str | None] = ("a", None)
    text: tuple[str, str | None] | None = None
    badge: tuple[str, str | None] | None = None


def extract_cards(pages: DataFrame, spec: CardSpec) -> DataFrame:
    """One row per repeated card: page_id, pos, classes, title, link, text, badge."""
    def part(card: Element, where) -> str | None:
        found = card.first(*where) if where else None
        return found.text() if found else None

    def rows_of(page_id, html) -> Iterator[tuple]:
        for page in _parsed(html):
            for pos, card in enumerate(page.all(*spec.card)):
                link = card.first(*spec.link)
                yield (page_id, pos, card.attrs.get("class", ""),
                       (part(card, spec.title) or "") if spec.title else card.text(),
                       link.attrs.get("href") if link else None,
                       part(card, spec.text), part(card, spec.badge))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _in_pieces(batches, rows_of, ["page_id", "pos", "classes", "title", "link", "text",
                                             "badge"], {"pos": "int32"})

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInPandas(
        run, f"page_id {id_type}, pos int, classes string, title string, link string, "
             "text string, badge string")


def _page_rows(pages: DataFrame, schema: str, rows_of) -> DataFrame:
    """(page_id, *schema) of `rows_of(parsed page)`, page by page."""
    names = ["page_id", *(c.split()[0] for c in schema.split(", "))]

    def of_page(page_id, html) -> Iterator[tuple]:
        for page in _parsed(html):
            for row in rows_of(page):
                yield (page_id, *row)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _in_pieces(batches, of_page, names)

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInPandas(run, f"page_id {id_type}, {schema}")


def text_around(pages: DataFrame, mark: tuple[str, str | None], around: tuple[str | None, str | None],
                part: tuple[str, str | None] = ("p", None)) -> DataFrame:
    """(page_id, text): the first `part` in the nearest `around` of a page's first `mark`. Pages
    without one of them have no row."""
    def rows_of(page: Element) -> Iterator[tuple]:
        first = page.first(*mark)
        block = first.closest(*around) if first else None
        found = block.first(*part) if block else None
        if found:
            yield (found.text(),)

    return _page_rows(pages, "text string", rows_of)


def text_beside_anchors(pages: DataFrame, prefix: str, around: str = "td", part: str = "p",
                        skip: int = 1) -> DataFrame:
    """(page_id, pos, href, text): for every anchor to a path with the prefix, the parts of the
    nearest `around` behind the first `skip`, which name the record, in one text."""
    def rows_of(page: Element) -> Iterator[tuple]:
        for pos, anchor in enumerate(page.all("a")):
            href = anchor.attrs.get("href", "")
            if href.startswith(prefix):
                cell = anchor.closest(around)
                texts = [x.text() for x in cell.all(part)][skip:] if cell else []
                yield pos, href, " ".join(t for t in texts if t)

    return _page_rows(pages, "pos int, href string, text string", rows_of)


def extract_nested(pages: DataFrame, prefix: str = "heading", html: str = "html") -> DataFrame:
    """Two-level accordion: items `prefix-group-item` under headers `prefix-group`.

    The header is found by id, not by nesting. A name is the first link in the `h5` of its
    element, else the text of the `h5`, else of the whole element; of elements with one id the
    last one's name counts. An item without header keeps a null group_name and a warning.
    """
    def name_of(element: Element) -> str:
        title = element.first("h5")
        return ((title.first("a") or title) if title else element).text()

    def rows_of(page_id, html) -> Iterator[tuple]:
        names = {}
        for page in _parsed(html):
            for element in page.all():
                if element.attrs.get("id", "").startswith(f"{prefix}-"):
                    names[element.attrs["id"]] = name_of(element)
        for pos, (key, name) in enumerate(names.items()):
            parts = key[len(prefix) + 1:].split("-")
            if len(parts) == 2:
                group = names.get(f"{prefix}-{parts[0]}")
                warning = ("item has no name" if not name else
                           "item has no group header" if group is None else None)
                yield page_id, parts[0], pos, parts[1], name, group, warning

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _in_pieces(batches, rows_of, ["page_id", "group_id", "pos", "item_id", "name",
                                             "group_name", "warning"], {"pos": "int32"})

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", html).mapInPandas(
        run, f"page_id {id_type}, group_id string, pos int, item_id string, name string, "
             "group_name string, warning string")


# --- record rules ------------------------------------------------------------------------

def dedupe_in_page(records: DataFrame, page: str = "page_id", key: str = "slug"
                   ) -> tuple[DataFrame, DataFrame]:
    """(kept, warnings): the first of each key in a page stays, the rest become warnings."""
    ranked = records.withColumn("_n", F.row_number().over(
        Window.partitionBy(page, key).orderBy("pos")))
    kept = ranked.filter(F.col("_n") == 1).drop("_n")
    extra = ranked.filter(F.col("_n") > 1).drop("_n").withColumn(
        "warning", F.concat(F.lit("duplicate on this page: "), F.col(key)))
    return kept, extra


def prefer(df: DataFrame, first: str, second: str, out: str) -> DataFrame:
    """`first`, else `second`; a warning where both are given and differ."""
    a, b = F.nullif(F.col(first), F.lit("")), F.nullif(F.col(second), F.lit(""))
    return df.withColumn(out, F.coalesce(a, b)).withColumn("warning", F.when(
        a != b, F.concat(F.lit(f"{first} and {second} differ; using {first}"))))


def gate_by_caption(df: DataFrame, name: str, caption: str, role: str = "head") -> DataFrame:
    """Publish a person only where the caption states the role; else warn."""
    stated = F.regexp(F.coalesce(F.col(caption), F.lit("")), F.lit(f"(?i){role}"))
    named = F.coalesce(F.col(name), F.lit("")) != ""
    return df.withColumn("published_name", F.when(stated & named, F.col(name))).withColumn(
        "warning", F.when(named & ~stated, "caption does not state the role; not published"))


def flag_embeds(pages: DataFrame, tag: str = "embed", attr: str = "src",
                contains: str = "drive.google.com", html: str = "html") -> DataFrame:
    """Pages that carry an embedded viewer in place of content, with the number of embeds."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\s[^>]*>"), F.lit(0))
    hits = F.filter(tags, lambda t: F.contains(
        F.coalesce(attribute(t, attr), F.lit("")), F.lit(contains)))
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.size(hits).alias("embeds"),
                        (F.size(hits) > 0).alias("is_embed"))


def owner_from_tokens(df: DataFrame, known: Sequence[str], tokens: Column,
                      out: str = "unit_slug") -> DataFrame:
    """First token that names a known owner; null when none does."""
    return df.withColumn(out, F.get(F.filter(tokens, lambda t: t.isin(*known)), F.lit(0)))


def verbatim_check(records: DataFrame, pages: DataFrame, name: str = "name",
                   html: str = "html") -> DataFrame:
    """Whether each emitted name occurs word for word in the page it came from."""
    # The generator settles the text once per page; a plain projection would be worked out
    # again for every record the join finds.
    bodies = pages.select("page_id", F.explode(F.array(text_of(F.col(html)))).alias("_text"))
    return records.join(bodies, "page_id").withColumn(
        "verbatim", F.contains("_text", X.clean(F.col(name)))).drop("_text")


def discover_items(index_pages: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """Second discovery pass: item URLs on index pages, resolved against the page's own, that
    are not registered yet."""
    anchors = extract_anchors(index_pages).filter(F.col("href").isNotNull())
    absolute = U.resolve(F.col(url), F.trim(F.col("href")))
    found = anchors.select(U.normalize_url(absolute).alias("item_url")).filter(
        F.col("item_url").isNotNull()).distinct()
    known = sources.select(U.normalize_url(F.col("url")).alias("item_url"))
    return found.join(known, "item_url", "left_anti")
