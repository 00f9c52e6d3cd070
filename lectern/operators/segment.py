"""From an ordered element stream to books, chapters, verses and placed images.

The walk over a page (which chapter am I in, have I seen a verse yet, which verse does
this picture belong to) becomes windows over the page.  A page is one input row, so its
elements always fit the task that parsed it; every window here is partitioned by the page
(and something inside it), so the whole walk costs a single shuffle by page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import (
    collapse,
    image_stem,
    is_any_page_mark,
    is_chapter_heading,
    is_content_image,
    is_filled,
    is_numbered_chapter,
    is_page_mark,
    parse_numbered,
    parse_verse,
    same_heading,
    split_anchor,
    squeeze,
    squeeze_ends,
    starts_chapter,
)
from lectern.operators.sizing import small_side

CONTEXT = "struct<seg:bigint,slug:string,chapter:bigint,mode:string,g_slug:string,g_chapter:bigint>"
VERSE_REF = "struct<pos:bigint,seg:bigint>"


def _before(value: Column) -> Column:
    """Last non-null value at or before each element of the page."""
    w = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def _after(value: Column) -> Column:
    """First non-null value at or after each element of the page."""
    w = W.partitionBy("page_id").orderBy("pos").rowsBetween(0, W.unboundedFollowing)
    return F.first(value, ignorenulls=True).over(w)


def _verse_ref(seg: Column) -> Column:
    ref = F.struct(F.col("pos").cast("bigint").alias("pos"), seg.cast("bigint").alias("seg"))
    return F.when(F.col("is_verse"), ref.cast(VERSE_REF))


def with_context(elements: DataFrame, anchors: DataFrame) -> DataFrame:
    """Give every element the context set by the last structural anchor before it.

    ``anchors`` has (key, kind, slug, chapter).  Kinds: ``gallery_last_verse`` and
    ``gallery_frontispiece`` (redirect pictures), ``title`` (a book begins), ``section``
    (a section book begins: the context ends), ``chapter`` (key is the anchor prefix, the
    number follows).  Galleries win over titles, titles over chapters; other anchors are
    ignored.
    """
    names = small_side(
        anchors.where(F.col("kind") != "chapter").select(
            F.col("key").alias("_name"),
            F.struct("kind", "slug", "chapter").alias("_by_name"),
        )
    )
    prefixes = small_side(
        anchors.where(F.col("kind") == "chapter").select(
            F.col("key").alias("_prefix"), F.col("slug").alias("_by_prefix")
        )
    )
    is_anchor = (F.col("tag") == "a") & is_filled(F.col("name"))
    parts = split_anchor(F.col("name"))
    rows = (
        elements.withColumn("_name", F.when(is_anchor, F.col("name")))
        .withColumn("_prefix", F.when(is_anchor, parts["prefix"]))
        .withColumn("_number", F.when(is_anchor, parts["number"]))
        .join(names, "_name", "left")
        .join(prefixes, "_prefix", "left")
    )
    kind = F.col("_by_name.kind")
    null_text, null_long = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def context(slug: Column, chapter: Column, mode: Column, g_slug: Column, g_chapter: Column):
        return F.struct(
            F.col("pos").cast("bigint").alias("seg"), slug.alias("slug"),
            chapter.cast("bigint").alias("chapter"), mode.alias("mode"),
            g_slug.alias("g_slug"), g_chapter.cast("bigint").alias("g_chapter"),
        ).cast(CONTEXT)

    zero = F.lit(0)
    ctx = (
        F.when(
            kind.startswith("gallery"),
            context(null_text, zero, kind, F.col("_by_name.slug"), F.col("_by_name.chapter")),
        )
        .when(kind == "section", context(null_text, zero, F.lit("text"), null_text, null_long))
        .when(kind == "title", context(F.col("_by_name.slug"), zero, F.lit("text"), null_text, null_long))
        .when(
            F.col("_by_prefix").isNotNull(),
            context(F.col("_by_prefix"), F.col("_number"), F.lit("text"), null_text, null_long),
        )
    )
    marked = rows.withColumn("_ctx", ctx).drop(
        "_name", "_prefix", "_number", "_by_name", "_by_prefix"
    )
    return marked.withColumn("ctx", _before(F.col("_ctx"))).withColumn(
        "is_context_anchor", F.col("_ctx").isNotNull()
    ).drop("_ctx")


def with_verses(placed: DataFrame) -> DataFrame:
    """Recognise verses inside chapters; add the verse at or before and after each row."""
    in_chapter = F.col("ctx.slug").isNotNull() & (F.col("ctx.chapter") > 0)
    verse = F.when((F.col("tag") == "p") & in_chapter, parse_verse(F.col("text")))
    marked = placed.withColumn("verse", verse).withColumn(
        "is_verse", F.coalesce(F.col("verse.is_verse"), F.lit(False))
    )
    ref = _verse_ref(F.col("ctx.seg"))
    return marked.withColumn("last_verse", _before(ref)).withColumn("next_verse", _after(ref))


def standard_rows(elements: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every kept element with its role and where it goes.

    role ``verse`` / ``preamble`` / ``image``; ``target_seg`` and ``target_pos`` name the
    segment and (for images) the verse that receives it.  Pictures after a verse belong to
    that verse; before any verse they wait for the next verse, also across chapters
    without verses; pictures outside every book are dropped.  Gallery pictures go to the
    last verse of the named chapter or wait for the next verse.
    """
    rows = with_verses(with_context(elements, anchors))
    seen = F.coalesce(F.col("last_verse.seg") == F.col("ctx.seg"), F.lit(False))
    in_chapter = F.col("ctx.slug").isNotNull() & (F.col("ctx.chapter") > 0)
    flat = collapse(F.col("text"))
    role = (
        F.when(F.col("is_verse"), "verse")
        .when(
            (F.col("tag") == "p") & in_chapter & ~seen & (flat != "") & ~is_numbered_chapter(flat),
            "preamble",
        )
        .when(
            (F.col("tag") == "img") & is_content_image(F.col("src"))
            & (F.col("ctx.slug").isNotNull() | F.col("ctx.mode").startswith("gallery")),
            "image",
        )
    )
    rows = rows.withColumn("role", role).where(F.col("role").isNotNull()).withColumn("_seen", seen)
    # Last verse of every (book, chapter) of the page: the segment that finally counts.
    # Gallery pictures look it up under the chapter they are sent to.
    to_last = (F.col("role") == "image") & (F.col("ctx.mode") == "gallery_last_verse")
    key = F.when(to_last, F.struct(F.col("ctx.g_slug").alias("s"), F.col("ctx.g_chapter").alias("c"))).when(
        F.col("role") == "verse", F.struct(F.col("ctx.slug").alias("s"), F.col("ctx.chapter").alias("c"))
    )
    same = W.partitionBy("page_id", "_key")
    is_verse = F.col("role") == "verse"
    end = F.struct(
        F.max(F.when(is_verse, F.col("ctx.seg"))).over(same).alias("seg"),
        F.max(F.when(is_verse, F.col("pos").cast("bigint"))).over(same).alias("pos"),
    )
    rows = rows.withColumn("_key", key).withColumn("_end", end)
    here = F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("ctx.seg").alias("seg"))
    target = (
        F.when(F.col("role") != "image", here)
        .when(
            to_last,
            F.when(
                F.col("_end.seg") < F.col("ctx.seg"),
                F.struct(F.col("_end.pos").alias("pos"), F.col("_end.seg").alias("seg")),
            ),
        )
        .when(F.col("_seen"), F.col("last_verse"))
        .otherwise(F.col("next_verse"))
    )
    every = rows.withColumn("target_seg", target["seg"]).withColumn("target_pos", target["pos"])
    return every.where(F.col("target_seg").isNotNull()).select(
        "page_id", "pos", "role", F.col("ctx.slug").alias("slug"),
        F.col("ctx.chapter").alias("chapter"), F.col("ctx.seg").alias("seg"),
        F.col("verse.number").alias("number"),
        F.when(F.col("role") == "verse", F.col("verse.rest"))
        .when(F.col("role") == "preamble", flat).alias("text"),
        "src", "target_seg", "target_pos",
    )


def section_rows(
    elements: DataFrame, prefix: str | Column, slug: str | Column, skip: Sequence[str] = ()
) -> DataFrame:
    """Books whose chapters are named sections (anchors ``<prefix>...``).

    Here a picture waits for the next verse of its section, trailing pictures go to the
    section's last verse, and a section without verses passes its pictures on.  ``chapter``
    numbers the sections that have verses 1..n.  Prefix and slug may be columns of the page.
    """
    name = F.col("name")
    is_anchor = (F.col("tag") == "a") & is_filled(name)
    skipped = F.lit(False)
    for other in skip:
        skipped = skipped | name.startswith(other)
    starts = F.coalesce(is_anchor & name.startswith(prefix) & ~skipped, F.lit(False))
    stops = F.coalesce(is_anchor & ~name.startswith(prefix) & ~skipped, F.lit(False))
    at = F.col("pos").cast("bigint")
    placed = (
        elements.withColumn("slug", F.lit(slug))
        .withColumn("_start", F.when(starts, at)).withColumn("_stop", F.when(stops, at))
        .withColumn("seg", _before(F.col("_start"))).withColumn("_last_stop", _before(F.col("_stop")))
        .withColumn("_next_start", _after(F.col("_start")))
    )
    # Only the last section of a page is ended by a foreign anchor.
    inside = F.col("seg").isNotNull() & ~(
        F.col("_next_start").isNull() & F.coalesce(F.col("_last_stop") > F.col("seg"), F.lit(False))
    )
    verse = F.when(F.col("tag") == "p", parse_verse(F.col("text")))
    placed = placed.where(inside).withColumn("verse", verse).withColumn(
        "is_verse", F.coalesce(F.col("verse.is_verse"), F.lit(False))
    )
    ref = _verse_ref(F.col("seg"))
    placed = placed.withColumn("last_verse", _before(ref)).withColumn("next_verse", _after(ref))
    seen = F.coalesce(F.col("last_verse.seg") == F.col("seg"), F.lit(False))
    ahead = F.coalesce(F.col("next_verse.seg") == F.col("seg"), F.lit(False))
    flat = collapse(F.col("text"))
    role = (
        F.when(F.col("is_verse"), "verse")
        .when((F.col("tag") == "p") & ~seen & (flat != ""), "preamble")
        .when((F.col("tag") == "img") & is_content_image(F.col("src")), "image")
    )
    target = (
        F.when(ahead, F.col("next_verse")).when(seen, F.col("last_verse")).otherwise(F.col("next_verse"))
    )
    rows = placed.withColumn("role", role).where(F.col("role").isNotNull()).select(
        "page_id", "pos", "role", "seg", F.col("verse.number").alias("number"),
        F.when(F.col("role") == "verse", F.col("verse.rest"))
        .when(F.col("role") == "preamble", flat).alias("text"),
        "src", "slug",
        F.when(F.col("role") == "image", target["seg"]).otherwise(F.col("seg")).alias("target_seg"),
        F.when(F.col("role") == "image", target["pos"]).otherwise(F.col("pos").cast("bigint")).alias("target_pos"),
    ).where(F.col("target_seg").isNotNull())
    # Dense numbers for the sections that have verses; the others receive nothing.
    full = F.max(F.col("role") == "verse").over(W.partitionBy("page_id", "target_seg"))
    counted = W.partitionBy("page_id").orderBy("target_seg")
    return rows.withColumn("_full", full).where("_full").withColumn(
        "chapter", F.dense_rank().over(counted).cast("bigint")
    ).drop("_full")


def last_segments(rows: DataFrame) -> DataFrame:
    """(page_id, slug, chapter, seg): a repeated chapter anchor replaces the earlier one."""
    return rows.where(F.col("role") == "verse").groupBy("page_id", "slug", "chapter").agg(
        F.max("seg").alias("seg")
    )


def assemble_chapters(rows: DataFrame, captions: DataFrame | None = None, edition: str = "1",
                      source: str | None = None) -> DataFrame:
    """Nested chapters from placed rows; one grouping per (page, segment).

    ``captions`` maps a file name to its caption; a picture without one has none.  When
    ``captions`` also lists files with a null caption, it doubles as the file inventory:
    pictures whose file is not listed are dropped.
    """
    if captions is not None:
        known = small_side(captions.select(F.col("file").alias("_file"), F.col("caption").alias("_cap")))
        rows = rows.withColumn(
            "_file", F.when(F.col("role") == "image", F.element_at(F.split("src", "/"), -1))
        ).join(known.withColumn("_known", F.lit(True)), "_file", "left").where(
            (F.col("role") != "image") | F.col("_known")
        )
    else:
        rows = rows.withColumn("_cap", F.lit(None).cast("string"))
    item = F.struct("pos", "target_pos", "role", "number", "text", "src", "_cap")
    is_verse = F.col("role") == "verse"
    grouped = rows.groupBy("page_id", "target_seg").agg(
        F.array_sort(F.collect_list(item)).alias("_items"),
        F.max(F.when(is_verse, F.col("slug"))).alias("slug"),
        F.max(F.when(is_verse, F.col("chapter"))).alias("chapter"),
    ).where(F.col("slug").isNotNull())
    # A repeated chapter anchor with verses replaces the earlier segment.
    latest = F.max("target_seg").over(W.partitionBy("page_id", "slug", "chapter"))
    joined = grouped.withColumn("_latest", latest).where(F.col("target_seg") == F.col("_latest"))
    items = F.col("_items")
    verses = F.filter(items, lambda x: x["role"] == "verse")

    def image(x: Column) -> Column:
        none = F.lit(None).cast("string")
        caption = F.when(
            is_filled(x["_cap"]),
            F.struct(x["_cap"].alias("en"), none.alias("zh_hant"), none.alias("zh_hans"),
                     none.alias("ja")),
        )
        return F.struct(x["src"].alias("src"), F.lit(edition).alias("edition"), caption.alias("caption"))

    def verse(v: Column) -> Column:
        none = F.lit(None).cast("string")
        texts = F.array().cast("array<string>")
        images = F.transform(
            F.filter(items, lambda x: (x["role"] == "image") & (x["target_pos"] == v["pos"])), image
        )
        return F.struct(
            F.concat_ws(".", F.col("slug"), F.col("chapter").cast("string"), v["number"].cast("string")).alias("id"),
            v["number"].alias("verse_number"), v["text"].alias("en"),
            none.alias("zh_hant"), none.alias("zh_hans"), none.alias("ja"),
            texts.alias("glossary_terms"), F.lit(None).cast("int").alias("plate_ref"),
            texts.alias("notes"), F.when(F.size(images) > 0, images).alias("images"),
        )

    preamble = collapse(
        F.array_join(F.transform(F.filter(items, lambda x: x["role"] == "preamble"), lambda x: x["text"]), " ")
    )
    none = F.lit(None).cast("string")
    return joined.select(
        "page_id",
        F.concat_ws(".", "slug", F.col("chapter").cast("string")).alias("id"),
        F.col("slug").alias("book"), F.col("chapter").cast("bigint").alias("chapter"),
        F.concat("slug", F.lit(" — Chapter "), F.col("chapter").cast("string")).alias("title"),
        F.struct(F.nullif(preamble, F.lit("")).alias("en"), none.alias("zh_hant"),
                 none.alias("zh_hans"), none.alias("ja")).alias("preamble"),
        F.when(preamble != "", F.lit(source)).alias("preamble_source"),
        F.transform(verses, verse).alias("verses"),
    )


def union_sources(standard: DataFrame, sections: DataFrame) -> DataFrame:
    """Section books replace standard chapters of the same book."""
    replaced = sections.select("book").distinct()
    return standard.join(replaced, "book", "left_anti").unionByName(sections)


# --- plain pages (one chapter per page) -----------------------------------------------


def page_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Verses and preamble of pages that hold one chapter each.

    ``paragraphs`` has (page_id, pos, text, title).  On a page without any numbered verse
    every kept paragraph becomes a verse 1..n; page marks, chapter headings and repeats of
    the title are dropped.  Result: role, number, text.
    """
    parsed = parse_numbered(F.col("text"))
    rows = paragraphs.where(is_filled(F.col("text"))).withColumn("_v", parsed)
    first = F.min(F.when(F.col("_v.is_verse"), F.col("pos"))).over(W.partitionBy("page_id"))
    rows = rows.withColumn("_first", first)
    noise = is_page_mark(F.col("text")) | is_chapter_heading(F.col("text"))
    is_title = F.lower(squeeze_ends(F.col("text"))) == F.lower("title")
    numbered_page = F.col("_first").isNotNull()
    role = (
        F.when(F.col("_v.is_verse"), "verse")
        .when(numbered_page & (F.col("pos") < F.col("_first")) & ~noise & ~is_title, "preamble")
        .when(~numbered_page & ~noise & ~same_heading(F.col("text"), F.col("title")), "implicit")
    )
    kept = rows.withColumn("role", role).where(F.col("role").isNotNull())
    place = F.row_number().over(W.partitionBy("page_id", "role").orderBy("pos"))
    counted = kept.withColumn("_all", place)
    return counted.select(
        "page_id", "pos", F.when(F.col("role") == "implicit", "verse").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "verse", F.col("_v.number"))
        .when(F.col("role") == "implicit", F.col("_all").cast("int")).alias("number"),
        F.when(F.col("role") == "verse", F.col("_v.rest")).otherwise(squeeze_ends(F.col("text"))).alias("text"),
    )


def epigraphs(paragraphs: DataFrame, footer: str) -> DataFrame:
    """(page_id, epigraph): paragraphs before the first verse, without marks and headings.

    ``footer`` is a pattern (any case) of site footers to leave out.
    """
    rows = paragraphs.withColumn("_t", squeeze(F.col("text"))).where(F.col("_t") != "")
    stop = F.col("_t").rlike(r"(?U)^\d+\.\s")
    first = F.min(F.when(stop, F.col("pos"))).over(W.partitionBy("page_id"))
    kept = rows.withColumn("_first", first).where(
        (F.col("_first").isNull() | (F.col("pos") < F.col("_first")))
        & ~is_any_page_mark(F.col("_t")) & ~F.col("_t").rlike(f"(?i){footer}")
        & ~starts_chapter(F.col("_t"))
    )
    joined = kept.groupBy("page_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda p: p["_t"]), " "
        ).alias("epigraph")
    )
    return paragraphs.select("page_id").distinct().join(joined, "page_id", "left").select(
        "page_id", F.coalesce("epigraph", F.lit("")).alias("epigraph")
    )


def plate_refs(verses: DataFrame, plates: DataFrame) -> DataFrame:
    """Image source of a verse to the plate number; unknown images give null."""
    ids = plates.select(F.col("img_id").alias("_stem"), F.col("id").alias("plate_ref"))
    return verses.withColumn("_stem", image_stem(F.col("src"))).join(ids, "_stem", "left").drop("_stem")
