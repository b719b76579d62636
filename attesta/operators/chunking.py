"""Heading-aware chunking of markdown, inside the row: no shuffle, no Python.

Every step maps a document's array of sections to another array of sections, so a corpus is
chunked in one pass over its scan. Token counts are whitespace words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions.hashing import content_hash
from attesta.functions.text import unescape

# Separators of the context header.
_TRAIL = " › "
_DOT = " · "


def markdown_of_html(html: Column) -> Column:
    """Headings and paragraphs of an HTML page as markdown; navigation and code dropped."""
    text = F.regexp_replace(
        html, r"(?is)<!--.*?-->|<(script|style|nav|footer|head)\b.*?</\1\s*>", " ")
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?is)\s*<h{level}\b[^>]*>\s*", "\n\n" + "#" * level + " ")
    text = F.regexp_replace(text, r"(?i)\s*</?(h[1-6]|p|div|li|ul|ol|article|section|br)\b[^>]*>\s*",
                            "\n\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    return strip(F.regexp_replace(unescape(text), r"\n{3,}", "\n\n"))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def token_count(content: Column) -> Column:
    return F.size(F.filter(F.split(content, r"\s+"), lambda w: w != ""))


def sections(markdown: Column) -> Column:
    """Split at level-2 and level-3 headings; `path` holds the headings above the content.

    Blocks are cut at level 2, then each block at level 3, so every heading is looked at once.
    """
    def heading(part: Column, level: int) -> Column:
        found = strip(F.regexp_extract(part, rf"^#{{{level}}} ([^\n]*)", 1))
        return F.when(F.startswith(part, F.lit("#" * level + " ")), found)

    def section(block: Column, part: Column) -> Column:
        return F.struct(
            F.array_compact(F.array(heading(block, 2), heading(part, 3))).alias("path"),
            strip(F.regexp_replace(part, r"^#{2,3} [^\n]*\n?", "")).alias("content"))

    blocks = F.split(markdown, r"(?m)(?=^## )")
    return F.flatten(F.transform(blocks, lambda block: F.transform(
        F.filter(F.split(block, r"(?m)(?=^### )"), lambda p: strip(p) != ""),
        lambda part: section(block, part))))


def split_large(parts: Column, limit: int = K.SPLIT_TOKENS) -> Column:
    """Sections over the limit packed paragraph by paragraph, path repeated.

    A single paragraph over the limit stays whole.
    """
    def packed(content: Column) -> Column:
        paragraphs = F.filter(F.split(content, r"\n+"), lambda p: strip(p) != "")
        start = F.struct(F.array().cast("array<string>").alias("done"),
                         F.lit("").alias("open"), F.lit(0).alias("size"))

        def add(acc: Column, paragraph: Column) -> Column:
            n = token_count(paragraph)
            fits = (acc["size"] == 0) | (acc["size"] + n <= limit)
            return F.struct(
                F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
                .alias("done"),
                F.when(acc["size"] == 0, paragraph).when(
                    fits, F.concat_ws("\n\n", acc["open"], paragraph)).otherwise(paragraph)
                .alias("open"),
                F.when(fits, acc["size"] + n).otherwise(n).alias("size"))

        return F.aggregate(paragraphs, start, add, lambda acc: F.array_append(
            acc["done"], acc["open"]))

    return F.flatten(F.transform(parts, lambda s: F.when(
        token_count(s["content"]) > limit,
        F.transform(packed(s["content"]), lambda c: F.struct(
            s["path"].alias("path"), c.alias("content"))))
        .otherwise(F.array(s))))


def merge_small(parts: Column, limit: int = K.MERGE_TOKENS) -> Column:
    """Sections under the limit join the next sibling (same parent heading); the path of the
    first is kept. A small last sibling stays as it is."""
    def parent(s: Column) -> Column:
        return F.slice(s["path"], 1, F.greatest(F.size(s["path"]) - 1, F.lit(0)))

    counted = F.transform(parts, lambda s: F.struct(
        s["path"].alias("path"), s["content"].alias("content"),
        token_count(s["content"]).alias("n")))
    start = F.array().cast("array<struct<path:array<string>,content:string,n:int>>")

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (last["n"] < limit) & (parent(last) == parent(s))
        merged = F.struct(
            last["path"].alias("path"),
            F.concat_ws("\n\n", last["content"], s["content"]).alias("content"),
            (last["n"] + s["n"]).alias("n"))
        return F.when(F.coalesce(joins, F.lit(False)), F.array_append(
            F.slice(done, 1, F.size(done) - 1), merged)).otherwise(F.array_append(done, s))

    return F.aggregate(counted, start, add)


def context_header(site: Column, title: Column, edition: Column, path: Column) -> Column:
    """site, title (edition) and heading path, as one line in front of the content."""
    named = F.concat(title, F.when(edition.isNotNull(), F.concat(
        F.lit(" ("), edition, F.lit(")"))).otherwise(""))
    trail = F.when(F.size(path) > 0, F.array_join(path, _TRAIL))
    return F.concat_ws(_DOT, site, named, trail)


def chunk(docs: DataFrame, markdown: str = "markdown", split: int = K.SPLIT_TOKENS,
          merge: int = K.MERGE_TOKENS) -> DataFrame:
    """All chunks of all documents: the input columns but the text, plus chunk_no, path,
    content, token_count and content_hash."""
    merged = merge_small(split_large(sections(F.col(markdown)), split), merge)
    kept = [c for c in docs.columns if c != markdown]
    return docs.select(*kept, F.posexplode(merged).alias("chunk_no", "_chunk")).select(
        *kept, "chunk_no", F.col("_chunk.path").alias("path"),
        F.col("_chunk.content").alias("content"),
        F.col("_chunk.n").alias("token_count"),
        content_hash(F.col("_chunk.content")).alias("content_hash"))


def new_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Only chunks whose (entity_type, entity_id, content_hash) is not stored yet; copies of
    one content inside an entity count once."""
    key = ["entity_type", "entity_id", "content_hash"]
    return chunks.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def inherit(chunks: DataFrame, docs: DataFrame, key: str = "entity_id") -> DataFrame:
    """Chunks take confidence and verification date from their document."""
    return chunks.join(docs.select(key, "confidence", "last_verified_at"), key)
