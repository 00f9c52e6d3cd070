"""Chapters, verses and books: unnesting, nesting, counts, coverage, order, pages.

A chapter is one row (its verses are an array), so whatever concerns one chapter is
computed inside the row without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import (
    LANGS,
    caption_key,
    chapter_title,
    is_blank,
    is_filled,
    pct,
    title_from_slug,
)
from lectern.operators.ordered import number_rows
from lectern.operators.sizing import small_side

CHAPTER_BLOCK = 4096


def verses_of(chapters: DataFrame, context: bool = False) -> DataFrame:
    """One row per verse.  (chapter_id, ord) is the key: verse ids can repeat.

    ``context`` adds the English text of the verse before and after.
    """
    source = chapters.select(
        F.col("id").alias("chapter_id"), "book", "chapter", F.posexplode("verses").alias("_i", "v"),
        *([F.col("verses.en").alias("_all")] if context else []),
    )
    around = (
        [
            F.when(F.col("_i") > 0, F.get("_all", F.col("_i") - 1)).alias("previous"),
            F.get("_all", F.col("_i") + 1).alias("following"),
        ]
        if context
        else []
    )
    return source.select(
        "chapter_id", "book", "chapter", (F.col("_i") + 1).alias("ord"),
        F.col("v.id").alias("verse_id"), "v.verse_number", "v.en",
        *[f"v.{lang}" for lang in LANGS], "v.glossary_terms", "v.images", *around,
    )


def nest_verses(verses: DataFrame, heads: DataFrame) -> DataFrame:
    """Inverse of :func:`verses_of`; ``heads`` holds the other chapter columns."""
    null_int, no_notes = F.lit(None).cast("int"), F.array().cast("array<string>")
    rows = verses.groupBy("chapter_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "ord",
                    F.struct(
                        F.col("verse_id").alias("id"), "verse_number", "en", *LANGS,
                        "glossary_terms", null_int.alias("plate_ref"), no_notes.alias("notes"),
                        "images",
                    ).alias("v"),
                )
            ),
            lambda a, b: a["ord"] - b["ord"],
        ).alias("_sorted")
    )
    return (
        heads.join(rows, heads["id"] == rows["chapter_id"], "left")
        .withColumn("verses", F.coalesce(F.col("_sorted.v"), F.array().cast(_type(rows))))
        .drop("_sorted", "chapter_id")
    )


def _type(rows: DataFrame) -> str:
    fields = rows.schema["_sorted"].dataType.elementType["v"].dataType
    return f"array<{fields.simpleString()}>"


def captions_of(chapters: DataFrame) -> DataFrame:
    """One row per image with a non-empty English caption, keyed ``verse_id#index``."""
    images = chapters.select(
        F.col("id").alias("chapter_id"), "book", "chapter", F.posexplode("verses").alias("_i", "v")
    ).select(
        "chapter_id", "book", "chapter", (F.col("_i") + 1).alias("ord"),
        F.col("v.id").alias("verse_id"), F.posexplode("v.images").alias("img_i", "image"),
    )
    return images.where(is_filled(F.col("image.caption.en"))).select(
        "chapter_id", "book", "chapter", "ord", "verse_id", "img_i",
        caption_key(F.col("verse_id"), F.col("img_i")).alias("cap_idx"),
        F.col("image.src").alias("src"), "image.caption.en",
        *[f"image.caption.{lang}" for lang in LANGS],
    )


def records_of(chapters: DataFrame) -> DataFrame:
    """Every translatable record of a chapter: verses, the preamble, and captions with English.

    (chapter_id, label, en, languages); the label is ``verse <ord>``, ``preamble`` or
    ``caption <verse_id>#<index>``.  They are listed inside the chapter's row.
    """
    kind = "array<struct<label:string,en:string," + ",".join(f"{x}:string" for x in LANGS) + ">>"

    def record(label: Column, text: Column) -> Column:
        return F.struct(label.alias("label"), text["en"].alias("en"), *[text[x].alias(x) for x in LANGS])

    def of_verse(v: Column, i: Column) -> Column:
        captions = F.transform(
            v["images"],
            lambda im, k: F.when(
                is_filled(im["caption"]["en"]),
                record(F.concat(F.lit("caption "), caption_key(v["id"], k)), im["caption"]),
            ),
        )
        verse = record(F.concat(F.lit("verse "), (i + 1).cast("string")), v)
        return F.concat(
            F.array(verse).cast(kind), F.coalesce(F.array_compact(captions).cast(kind), F.array().cast(kind))
        )

    every = F.concat(
        F.array(record(F.lit("preamble"), F.col("preamble"))).cast(kind), F.flatten(F.transform("verses", of_verse))
    )
    return chapters.select(F.col("id").alias("chapter_id"), F.explode(every).alias("r")).select("chapter_id", "r.*")


def text_of(chapters: DataFrame, langs: Sequence[str], keep: Callable[[Column], Column] | None = None) -> Column:
    """All text of a chapter in the given languages, one line per record: preamble, verses, captions.

    ``keep`` tells which verses count, with their captions; the preamble always does.
    """
    none = F.array().cast("array<string>")

    def texts(holder: Column) -> Column:
        return F.array(*[holder[x] for x in langs])

    def of_verse(v: Column) -> Column:
        images = F.coalesce(v["images"], F.array().cast(_images(chapters)))
        return F.concat(texts(v), F.flatten(F.transform(images, lambda im: texts(im["caption"]))))

    verses = F.col("verses") if keep is None else F.filter("verses", keep)
    lines = F.concat(texts(F.col("preamble")), F.coalesce(F.flatten(F.transform(verses, of_verse)), none))
    return F.array_join(F.filter(lines, is_filled), "\n")


def in_verse_range(number: Column, vmin: int | None = None, vmax: int | None = None) -> Column:
    """Inclusive bounds; None leaves a side open."""
    keep = F.lit(True)
    if vmin is not None:
        keep = keep & (number >= vmin)
    if vmax is not None:
        keep = keep & (number <= vmax)
    return keep


def drop_empty_chapters(chapters: DataFrame) -> DataFrame:
    return chapters.where(F.coalesce(F.size("verses") > 0, F.lit(False)))


def untranslated(lang: str) -> Column:
    """No verse of the chapter has text in the language."""
    return ~F.exists("verses", lambda v: is_filled(v[lang]))


def image_count() -> Column:
    return F.aggregate(
        "verses", F.lit(0), lambda n, v: n + F.coalesce(F.size(v["images"]), F.lit(0))
    )


# --- counts ---------------------------------------------------------------------------


def corpus_counts(chapters: DataFrame) -> DataFrame:
    """One row: books, chapters, verses, images (one pass, partial sums per task)."""
    per_book = drop_empty_chapters(chapters).groupBy("book").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum(F.size("verses")).alias("v"),
        F.sum(image_count()).alias("i"),
    )
    return per_book.agg(
        F.count(F.lit(1)).alias("books"), F.sum("c").alias("chapters"),
        F.sum("v").alias("verses"), F.sum("i").alias("images"),
    )


def chapter_counts(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Chapters with verses per book, against the recorded number.

    ``chapter_count`` is the number to record from now on.
    """
    counted = drop_empty_chapters(chapters).groupBy("book").agg(
        F.count(F.lit(1)).alias("counted")
    )
    joined = books.join(counted, books["slug"] == counted["book"], "left")
    return joined.select(
        *[c for c in books.columns if c != "chapter_count"],
        F.col("chapter_count").cast("bigint").alias("recorded"), "counted",
        F.coalesce("counted", F.col("chapter_count").cast("bigint")).alias("chapter_count"),
        (F.col("counted").isNotNull()
         & ~F.col("counted").eqNullSafe(F.col("chapter_count").cast("bigint"))).alias("changed"),
    )


def translation_coverage(chapters: DataFrame) -> DataFrame:
    """Long form: filled verses per language with floor percentage, then the preambles."""

    def filled(lang: str) -> Column:
        return F.aggregate(
            "verses", F.lit(0), lambda n, v: n + F.when(is_filled(v[lang]), 1).otherwise(0)
        )

    english = ~is_blank(F.col("preamble.en"))
    sums = chapters.agg(
        F.coalesce(F.sum(F.size("verses")), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(filled(lang)), F.lit(0)).alias(lang) for lang in LANGS],
        F.count_if(english).alias("pre_total"),
        F.count_if(english & is_filled(F.col("preamble.zh_hant"))).alias("preamble"),
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(lang).alias("what"), F.col(lang).cast("bigint").alias("n"),
                         F.col("total").cast("bigint").alias("total"))
                for lang in LANGS
            ],
            F.struct(F.lit("preamble").alias("what"), F.col("preamble").alias("n"),
                     F.col("pre_total").alias("total")),
        )
    )
    return sums.select(rows.alias("r")).select(
        "r.what", "r.n", "r.total", pct(F.col("r.n"), F.col("r.total")).alias("share")
    )


def max_images(chapters: DataFrame) -> DataFrame:
    """Largest image count and its first verse in (book, chapter, position) order."""
    verses = chapters.select(
        "book", "chapter", F.posexplode("verses").alias("_i", "v")
    ).select(
        "book", "chapter", "_i", F.col("v.id").alias("verse_id"),
        F.coalesce(F.size("v.images"), F.lit(0)).alias("n"),
    )
    best = verses.agg(
        F.min(F.struct((-F.col("n")).alias("m"), "book", "chapter", "_i", "verse_id")).alias("b")
    )
    return best.select(
        (-F.col("b.m")).alias("max_images"), F.col("b.verse_id").alias("verse_id"),
        (-F.col("b.m") > 9).alias("pileup"),
    )


# --- order, books, pages --------------------------------------------------------------


def number_books(present: DataFrame, books: DataFrame) -> DataFrame:
    """1-based position among the books present: dimension order, then unknown by slug."""
    joined = present.select("book").distinct().join(
        books.select(F.col("slug").alias("book"), "title", F.col("position").alias("_p")),
        "book", "left",
    )
    keyed = joined.select(
        "book", "_p", F.coalesce("title", title_from_slug(F.col("book"))).alias("title"),
        F.col("_p").isNull().alias("_extra"),
        F.coalesce((F.col("_p") / CHAPTER_BLOCK).cast("bigint"), F.lit(0)).alias("_pb"),
        F.when(F.col("_p").isNull(), F.substring("book", 1, 6)).otherwise("").alias("_sb"),
    )
    numbered = number_rows(
        keyed, [], ["_extra", "_pb", "_sb"], [F.col("_p"), F.col("book")], "position"
    )
    return numbered.select("book", "title", "position")


def canonical_order(rows: DataFrame, numbered: DataFrame) -> DataFrame:
    """Sort by book position, chapter, verse (a distributed range sort)."""
    return rows.join(small_side(numbered.select("book", "position")), "book").orderBy(
        "position", "chapter", "ord"
    )


def derive_books(ranges: DataFrame) -> DataFrame:
    """Book dimension of a range table; ``position`` keeps its order."""
    return ranges.select(
        "slug", "title", (F.col("hi") - F.col("lo") + 1).alias("chapter_count"), "position"
    )


def page_layout(chapters: DataFrame) -> DataFrame:
    """Path of every page: one standalone page for single-chapter books, else a folder.

    Counts are pre-aggregated per book, so a huge book costs one small row.
    """
    heads = chapters.select("id", "book", "chapter")
    sizes = heads.groupBy("book").agg(F.count(F.lit(1)).alias("n_chapters"))
    single = F.col("n_chapters") == 1
    return heads.join(small_side(sizes), "book").select(
        "id", "book", "chapter", "n_chapters", (~single).alias("has_index"),
        F.when(single, F.col("book")).otherwise(
            F.concat("book", F.lit("/"), pad2(F.col("chapter")))
        ).alias("path"),
    )


def pad2(number: Column) -> Column:
    """At least two digits, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def book_source_text(chapters: DataFrame) -> DataFrame:
    """English of each chapter in document order, one piece per chapter.

    A preamble or caption that is empty is left out; a null verse stays as an empty line.
    The text of a book is its pieces in chapter order joined by line feeds; it is kept in
    pieces because a whole book need not fit one row.
    """

    def piece(v: Column) -> Column:
        captions = F.filter(
            F.transform(F.coalesce(v["images"], F.array().cast(_images(chapters))),
                        lambda im: im["caption"]["en"]),
            is_filled,
        )
        return F.concat(F.array(F.coalesce(v["en"], F.lit(""))), captions)

    preamble = F.when(is_filled(F.col("preamble.en")), F.array("preamble.en")).otherwise(
        F.array().cast("array<string>")
    )
    lines = F.concat(preamble, F.flatten(F.transform("verses", piece)))
    return chapters.select("book", "chapter", F.array_join(lines, "\n").alias("text"))


def _images(chapters: DataFrame) -> str:
    verse = chapters.schema["verses"].dataType.elementType
    return verse["images"].dataType.simpleString()


def with_titles(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Chapter titles from the book dimension, the slug standing in for a missing title."""
    names = books.select(F.col("slug").alias("book"), F.col("title").alias("_t"))
    return chapters.join(names, "book", "left").withColumn(
        "title", chapter_title(F.col("_t"), F.col("book"), F.col("chapter"))
    ).drop("_t")


def first_of_each(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """First row per key; merges partial results, so many copies of a key are cheap."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(
        F.min_by(F.struct(*others), order).alias("_r")
    ).select(key, *[f"_r.{c}" for c in others])
