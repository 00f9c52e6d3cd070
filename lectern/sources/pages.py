"""Rendered pages: one text body per chapter, book indexes, the top index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.corpus import page_layout
from lectern.operators.ordered import number_sorted
from lectern.operators.sizing import small_side

LINKS_PER_PART = 1000


# The keys of a page's front matter and of its body.
def _front(ident: Column, title: Column, label: Column, position: Column) -> Column:
    return F.concat(
        F.lit("---\nid: "), ident, F.lit('\ntitle: "'), title, F.lit('"\nsidebar_label: "'), label,
        F.lit('"\nsidebar_position: '), position.cast("string"), F.lit("\n---\n"),
    )


def render_chapters(chapters: DataFrame, books: DataFrame, slices: DataFrame | None = None) -> DataFrame:
    """(path, body): front matter, the chapter as JSON, the dictionary slice.

    The only chapter of a book becomes the book's own page.  The epigraph of chapter 1 is
    hidden on chapter pages because the book index shows it.
    """
    layout = page_layout(chapters).select("id", "path", "has_index")
    rows = chapters.join(layout, "id").join(
        small_side(books.select("book", F.col("title").alias("_bt"), "position")), "book"
    )
    if slices is not None:
        rows = rows.join(slices, rows["id"] == slices["chapter_id"], "left")
        glossary = F.coalesce(slice_json(F.col("glossary")), F.lit("{}"))
    else:
        glossary = F.lit("{}")
    payload = F.to_json(
        F.struct("id", "book", "chapter", "title", "preamble", "preamble_source", "verses"),
        {"ignoreNullFields": "false"},
    )
    front = F.when(
        F.col("has_index"),
        _front(F.col("id"), F.col("title"),
               F.concat(F.lit("Chapter "), F.col("chapter").cast("string")), F.col("chapter")),
    ).otherwise(_front(F.col("book"), F.col("_bt"), F.col("_bt"), F.col("position")))
    hide = F.col("has_index") & (F.col("chapter") == 1)
    return rows.select(
        "book", "path",
        F.concat(
            front, F.lit("\nchapter: "), payload, F.lit("\nglossary: "), glossary,
            F.when(hide, "\nhidePreamble: true\n").otherwise("\n"),
        ).alias("body"),
    )


def slice_maps(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """(chapter_id, glossary entries of (headword, {translit, slug})) from (chapter_id, slug).

    Entries go by headword, those that share one in dictionary order.  They are a list and no
    map, since a headword that several terms share is no key; none of them is dropped.
    """
    entries = edges.join(terms.select("slug", "term", "translit", "position"), "slug")
    return entries.groupBy("chapter_id").agg(
        F.array_sort(
            F.collect_list(F.struct("term", "position", F.struct("translit", "slug").alias("v")))
        ).alias("glossary")
    )


def slice_json(glossary: Column) -> Column:
    """Glossary entries as the text of one JSON object, headword by headword."""

    def member(e: Column) -> Column:
        whole = F.to_json(F.create_map(e["term"], e["v"]))
        return F.substring(whole, F.lit(2), F.length(whole) - 2)

    return F.concat(F.lit("{"), F.array_join(F.transform(glossary, member), ","), F.lit("}"))


def quote(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "(?m)^", "> ")


def book_indexes(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book, path, part_no, body): ordered chapter links under the first epigraph.

    The link list of a huge book is cut into parts of 1000 links, each a page of its own;
    part 0 carries the head and is the book's index, further ones are ``index-1`` and on.
    """
    layout = page_layout(chapters).where("has_index").select("id", "book", "chapter")
    numbered = number_sorted(layout, ["book"], [F.col("chapter"), F.col("id")], "_n").withColumn(
        "part_no", F.floor((F.col("_n") - 1) / LINKS_PER_PART)
    )
    link = F.concat(
        F.lit("- [Chapter "), F.col("chapter").cast("string"), F.lit("](/"), F.col("book"), F.lit("/"),
        F.col("id"), F.lit(")"),
    )
    parts = numbered.groupBy("book", "part_no").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("chapter", link.alias("l")))), lambda x: x["l"]
            ),
            "\n",
        ).alias("links")
    )
    intro = chapters.groupBy("book").agg(F.min_by("preamble.en", "chapter").alias("_intro"))
    rows = parts.join(small_side(books.select("book", "title", "position")), "book").join(small_side(intro), "book")
    has_intro = F.coalesce(F.trim("_intro") != "", F.lit(False))
    head = F.concat(
        _front(F.col("book"), F.col("title"), F.col("title"), F.col("position")),
        F.lit("\n# "), F.col("title"), F.lit("\n"),
        F.when(has_intro, F.concat(F.lit("\n"), quote(F.col("_intro")), F.lit("\n"))).otherwise(""),
        F.lit("\n"),
    )
    return rows.select(
        "book", F.concat("book", F.lit("/index"), F.when(F.col("part_no") > 0, F.concat(F.lit("-"), F.col("part_no").cast("string"))).otherwise("")).alias("path"),
        "part_no",
        F.concat(F.when(F.col("part_no") == 0, head).otherwise(""), "links", F.lit("\n")).alias("body"),
    )


def top_index(numbered: DataFrame, dimension: DataFrame, title: str) -> DataFrame:
    """(line_no, line): links to the books that have chapters, in order.

    An empty corpus gives one placeholder line.
    """
    known = dimension.select(F.col("slug").alias("book"))
    links = numbered.join(known, "book", "left_semi").select(
        F.col("position").cast("bigint").alias("line_no"),
        F.concat(F.lit("- ["), "title", F.lit("](./"), "book", F.lit("/)")).alias("line"),
    )
    spark = numbered.sparkSession
    head = spark.createDataFrame([(0, f"# {title}")], "line_no bigint, line string")
    return head.unionByName(links)


def placeholder(numbered: DataFrame) -> DataFrame:
    """One line when there is no chapter at all, else nothing."""
    return numbered.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(0).cast("bigint").alias("line_no"), F.lit("Content is being prepared.").alias("line")
    )


def write_pages(pages: DataFrame, root: str) -> None:
    """Parquet by book; a page is one row, so any site builder can pick its share."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "book"
    ).parquet(root)
