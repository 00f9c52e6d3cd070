"""Source fingerprints: verse, chapter, book; drift and stale bindings.

Verse and chapter fingerprints are computed inside the chapter row.  A book fingerprint
hashes its chapter numbers and fingerprints as a tree over hash digits, so no task ever holds
the digests of a whole huge book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import caption_key, is_filled, sha16


def chapter_digest(verses: Column, preamble_en: Column) -> Column:
    """sha16 over verse ids and digests, the preamble, then captions, in document order."""
    verse_parts = F.transform(
        verses, lambda v: F.concat(F.lit("v:"), v["id"], F.lit(":"), sha16(v["en"]))
    )
    preamble = F.array(F.concat(F.lit("p:"), sha16(preamble_en)))

    def captions(v: Column) -> Column:
        parts = F.transform(
            v["images"],
            lambda im, i: F.when(
                is_filled(im["caption"]["en"]),
                F.concat(F.lit("c:"), caption_key(v["id"], i), F.lit(":"),
                         sha16(im["caption"]["en"])),
            ),
        )
        return F.coalesce(F.array_compact(parts), F.array().cast("array<string>"))

    parts = F.concat(verse_parts, preamble, F.flatten(F.transform(verses, captions)))
    return sha16(F.array_join(parts, "|"))


def chapter_fingerprints(chapters: DataFrame) -> DataFrame:
    return chapters.select(
        "book", "chapter", F.col("id").alias("chapter_id"),
        chapter_digest(F.col("verses"), F.col("preamble.en")).alias("src_sha"),
    )


def verse_fingerprints(chapters: DataFrame) -> DataFrame:
    return chapters.select(
        F.col("id").alias("chapter_id"), F.posexplode("verses").alias("_i", "v")
    ).select(
        "chapter_id", (F.col("_i") + 1).alias("ord"), F.col("v.id").alias("verse_id"),
        sha16(F.col("v.en")).alias("en_sha"),
    )


def book_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(book, book_en_sha) from (book, chapter, src_sha): one row per book.

    One rule for books of any size: the tree of :func:`snapshot_versions` over the chapter
    numbers and their digests.
    """
    parts = fingerprints.select(
        "book", F.lit("chapter").alias("part"), F.col("chapter").cast("string").alias("slug"), F.col("src_sha").alias("payload")
    )
    return snapshot_versions(parts).withColumnRenamed("version", "book_en_sha")


def build_manifest(chapters: DataFrame) -> DataFrame:
    """One row per mergeable English record: verse, preamble or caption."""
    def records(v: Column, i: Column) -> Column:
        verse = F.struct(
            F.lit("verse").alias("kind"), v["id"].alias("key"), (i + 1).alias("ord"),
            F.lit(-1).alias("img_i"), sha16(v["en"]).alias("en_sha"),
        )
        captions = F.transform(
            v["images"],
            lambda im, k: F.when(
                is_filled(im["caption"]["en"]),
                F.struct(
                    F.lit("caption").alias("kind"), caption_key(v["id"], k).alias("key"),
                    (i + 1).alias("ord"), k.alias("img_i"),
                    sha16(im["caption"]["en"]).alias("en_sha"),
                ),
            ),
        )
        kind = "array<struct<kind:string,key:string,ord:int,img_i:int,en_sha:string>>"
        return F.concat(F.array(verse).cast(kind),
                        F.coalesce(F.array_compact(captions).cast(kind), F.array().cast(kind)))

    kind = "array<struct<kind:string,key:string,ord:int,img_i:int,en_sha:string>>"
    preamble = F.array(
        F.struct(
            F.lit("preamble").alias("kind"), F.col("id").alias("key"), F.lit(0).alias("ord"),
            F.lit(-1).alias("img_i"), sha16(F.col("preamble.en")).alias("en_sha"),
        )
    ).cast(kind)
    every = F.concat(preamble, F.flatten(F.transform("verses", records)))
    return chapters.select(
        "book", "chapter", F.col("id").alias("chapter_id"), F.explode(every).alias("r")
    ).select("book", "chapter", "chapter_id", "r.*")


def require_chapters(chapters: DataFrame, wanted: DataFrame) -> DataFrame:
    """Books asked for that have no chapter at all (building their manifest is an error)."""
    return wanted.select("book").distinct().join(
        chapters.select("book").distinct(), "book", "left_anti"
    )


def drifted(live: DataFrame, recorded: DataFrame) -> DataFrame:
    """Chapters whose live fingerprint is not the recorded one (compare-and-set refusal)."""
    now = live.select("chapter_id", F.col("src_sha").alias("live_sha"))
    then = recorded.select("chapter_id", F.col("src_sha").alias("manifest_sha"))
    return now.join(then, "chapter_id").where(
        ~F.col("live_sha").eqNullSafe(F.col("manifest_sha"))
    )


def stale_bindings(results: DataFrame, snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """Three flags per result: wrong version, stale snapshot, changed source binding."""
    snap = snapshots.select("book", F.col("version").alias("_version"),
                            F.col("book_en_sha").alias("_snap_sha"))
    man = manifests.select("book", F.col("book_en_sha").alias("_man_sha"))
    joined = results.join(snap, "book", "left").join(man, "book", "left")
    return joined.select(
        "chapter_id", "book",
        (~F.col("snapshot_version").eqNullSafe(F.col("_version"))).alias("version_mismatch"),
        (~F.col("_snap_sha").eqNullSafe(F.col("_man_sha"))).alias("snapshot_stale"),
        (~F.col("book_en_sha").eqNullSafe(F.col("_man_sha"))).alias("binding_changed"),
    )


def canonical_row(*columns: str) -> Column:
    """Row as JSON with nulls kept and keys in the given order: the canonical form."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def snapshot_versions(parts: DataFrame) -> DataFrame:
    """(book, version) of snapshot content given as (book, part, slug, payload) rows.

    Parts are terms, lexicon, delta and the source fingerprint.  Rows are hashed one by
    one, gathered by the first four hex digits of the hash of their key, each gathering is
    hashed in key order, then again by two digits, then all: equal content gives an equal
    version in any row order, and no task holds more than a 65,536th of a book's rows.
    """
    level = parts.select(
        "book", F.concat_ws("\u0001", "part", "slug").alias("_k"),
        sha16(F.col("payload")).alias("_d"),
    ).withColumn("_b", sha16(F.col("_k")))
    for digits in (4, 2, 0):
        joined = F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_k", "_d"))),
                lambda r: F.concat(r["_k"], F.lit("="), r["_d"]),
            ),
            "\n",
        )
        level = level.groupBy("book", F.substring("_b", 1, digits).alias("_b")).agg(
            sha16(joined).alias("_d")
        ).withColumn("_k", F.col("_b"))
    return level.select("book", F.col("_d").alias("version"))
