"""HTML to ordered elements.

Parsing is the one step Spark has no expression for: ``mapInPandas`` streams batches of
pages through the standard-library parser, one page at a time.  Everything after it works
on plain columns.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions.text import (
    clean_definition,
    clean_headword,
    keep_headword,
    slugify,
)
from lectern.operators.corpus import first_of_each

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT = ("a", "p", "img", "h1", "h2", "h3", "blockquote", "dt", "dd", "b")
# Elements that a new element of the same kind ends when their end tag was left out.
ENDS_BEFORE = {"p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "li": ("li",)}
EMPTY = ("img", "br", "hr", "meta", "link", "input", "area", "base", "col", "embed", "wbr")
BATCH_ROWS = 20_000


class _Elements(HTMLParser):
    """Collects kept elements in document order; an element precedes what it contains."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple[str, int | None, int]] = []
        self.text: list[str] = []
        self.size = 0
        self.silent = 0

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            _, row, start = self.open.pop()
            if row is not None:
                self.rows[row][3] = (start, len(self.text))
                self.rows[row][4] = len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        if tag in EMPTY and tag != "img":
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] in ENDS_BEFORE.get(tag, ()):
                self._close(depth)
                break
        if tag in ("script", "style"):
            self.silent += 1
        row = None
        if tag in KEPT:
            found = dict(attrs)
            row = len(self.rows)
            self.rows.append([tag, found.get("name"), found.get("src") or found.get("href"),
                              None, row])
        if tag == "img":
            self.rows[row][3] = (0, 0)
        else:
            self.open.append((tag, row, len(self.text)))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                if tag in ("script", "style"):
                    self.silent -= 1
                self._close(depth)
                return

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)

    def finish(self) -> list[tuple]:
        self.close()
        self._close(0)
        return [
            (tag, name, src, "".join(self.text[span[0]:span[1]]), last)
            for tag, name, src, span, last in self.rows
        ]


def _shred(codec: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "pos", "tag", "name", "src", "text", "last"]
        rows: list[tuple] = []
        for batch in batches:
            for page_id, html in zip(batch["page_id"], batch["html"]):
                if html is None:
                    continue
                if codec is not None:
                    html = bytes(html).decode(codec, "replace")
                parser = _Elements()
                parser.feed(html)
                for pos, element in enumerate(parser.finish()):
                    rows.append((page_id, pos, *element))
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return run


def shred_html(pages: DataFrame, codec: str | None = None) -> DataFrame:
    """(page_id, html) to elements(page_id, pos, tag, name, src, text, last).

    ``last`` is the position of the last element inside (its own when it holds none).
    With ``codec`` the html column is binary and undecodable bytes are replaced.
    """
    return pages.select("page_id", "html").mapInPandas(_shred(codec), schemas.ELEMENT)


def flat_elements(pages: DataFrame) -> DataFrame:
    """Opening tags in order with the text up to the next tag, by expressions only.

    Enough for anchors, headings and flat paragraphs; no Python is involved.
    """
    pattern = r"(?s)<[a-zA-Z][a-zA-Z0-9]*[^>]*>[^<]*"
    cuts = F.regexp_extract_all(F.col("html"), F.lit(pattern), F.lit(0))
    return pages.select("page_id", F.posexplode(cuts).alias("pos", "_cut")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"),
        F.lower(F.regexp_extract("_cut", "^<([a-zA-Z0-9]+)", 1)).alias("tag"),
        F.nullif(F.regexp_extract("_cut", 'name="([^"]*)"', 1), F.lit("")).alias("name"),
        F.nullif(F.regexp_extract("_cut", '(?:src|href)="([^"]*)"', 1), F.lit("")).alias("src"),
        F.regexp_extract("_cut", r"(?s)>([^<]*)$", 1).alias("text"),
    )


def read_html(spark, path: str, codec: str) -> DataFrame:
    """Files to (page_id, path, html bytes); decode with :func:`shred_html`'s codec.

    The page id is the number in the file name, else a hash of the path.
    """
    files = spark.read.format("binaryFile").load(path)
    digits = F.regexp_extract("path", r"(\d+)\.html?$", 1).try_cast("bigint")
    return files.select(
        F.coalesce(digits, F.xxhash64("path")).alias("page_id"), "path",
        F.col("content").alias("html"),
    )


def headwords(elements: DataFrame) -> DataFrame:
    """Glossary entries: bold headword in a paragraph, else a dt with its dd.

    Same headword slug: bold paragraphs come before definition lists, then page order.
    """
    tag, text = F.col("tag"), content_text(F.col("text"))
    near = F.struct("pos", "text")
    ahead = W.partitionBy("page_id").orderBy("pos").rowsBetween(0, W.unboundedFollowing)
    paired = elements.where(F.col("tag").isin("p", "dt", "dd", "b")).withColumn(
        "_bold", F.first(F.when(F.col("tag") == "b", near), ignorenulls=True).over(ahead)
    ).withColumn("_dd", F.first(F.when(F.col("tag") == "dd", near), ignorenulls=True).over(ahead))
    # The nearest bold element ahead counts only when it lies inside this one.
    inside = F.coalesce(F.col("_bold.pos") <= F.col("last"), F.lit(False))
    term = clean_headword(content_text(F.col("_bold.text")))
    bold = paired.where(tag.isin("p", "dt") & inside).select(
        "page_id", "pos", F.lit(1).alias("strategy"), term.alias("term"),
        clean_definition(text, term).alias("definition"),
    ).where(keep_headword(F.col("term")) & (F.col("definition") != ""))
    name = clean_headword(text)
    listed = paired.where(tag == "dt").select(
        "page_id", "pos", F.lit(2).alias("strategy"), name.alias("term"),
        F.coalesce(content_text(F.col("_dd.text")), F.lit("")).alias("definition"),
    ).where(keep_headword(F.col("term")))
    return union_strategies(bold, listed)


def union_strategies(first: DataFrame, second: DataFrame) -> DataFrame:
    """Entries of both strategies, one per slug: lower strategy, page and position win."""
    every = first.unionByName(second).withColumn("slug", slugify(F.col("term")))
    return first_of_each(every, "slug", F.struct("strategy", "page_id", "pos"))


def anchor_table(rows: list[tuple[str, str, str | None, int | None]], spark) -> DataFrame:
    """Anchor dimension for segmentation from (key, kind, slug, chapter) tuples."""
    return spark.createDataFrame(rows, "key string, kind string, slug string, chapter bigint")


def content_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
