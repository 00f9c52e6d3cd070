"""All rules for a returned translation in one operator: what fails here is never merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import LANGS, caption_key, is_blank, is_filled, once
from lectern.operators import fingerprint as FP
from lectern.operators import quality as K
from lectern.operators.merge import results_by_position
from lectern.operators.sizing import small_ids
from lectern.operators.terms import term_forms
from lectern.session import cut_lineage


def _ids(verses: str) -> Column:
    return F.transform(verses, lambda v: v["id"])


def _pairs(chapters: DataFrame, results: DataFrame) -> DataFrame:
    """One row per result with what the cheap rules read of it and of its source chapter.

    Both sides meet without their running text: ids, caption keys, preamble and captions.  The
    lists of ids stay only where they differ, so the row is small and is kept for all rules.
    """
    none = F.array().cast("array<string>")

    def keys(v: Column) -> Column:
        return F.coalesce(F.array_compact(F.transform(
            v["images"], lambda im, k: F.when(is_filled(im["caption"]["en"]), caption_key(v["id"], k)))), none)

    source = chapters.select(
        F.col("id").alias("chapter_id"), is_filled(F.col("preamble.en")).alias("_prefaced"), _ids("verses").alias("_want"),
        F.flatten(F.transform("verses", keys)).alias("wanted"))
    given = results.select("chapter_id", "preamble", "captions", _ids("verses").alias("_got"))
    differ = ~F.col("_want").eqNullSafe(F.col("_got"))
    return given.join(source, "chapter_id").select(
        "chapter_id", "preamble", "captions", "_prefaced", "wanted", differ.alias("_differ"),
        *[F.when(differ, F.col(c)).alias(c) for c in ("_want", "_got")])


def _placed_ids(pairs: DataFrame, ids: str) -> DataFrame:
    rows = pairs.select("chapter_id", F.posexplode(ids).alias("_i", "verse_id"))
    return rows.select("chapter_id", (F.col("_i") + 1).alias("ord"), "verse_id")


def _found(rule: str, ident: Column, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.col("chapter_id").alias("path"), ident.alias("id"), detail.alias("detail"))


def _in_row(pairs: DataFrame) -> DataFrame:
    """Preamble and captions, judged inside the row that holds source and result."""
    kind = "array<struct<rule:string,path:string,id:string,detail:string>>"
    blank = lambda holder, x: is_blank(holder[x])
    preamble = [
        F.when(F.col("_prefaced") & blank(F.col("preamble"), x), _found("result.preamble", F.lit("preamble"), F.lit(f"missing {x}")))
        for x in LANGS
    ]
    none = F.array().cast("array<string>")
    wanted = F.col("wanted")
    given = F.coalesce(F.transform("captions", lambda c: c["cap_idx"]), none)
    missing = F.transform(F.array_except(wanted, given), lambda k: _found("caption.missing", k, F.lit("")))
    extra = F.transform(F.array_except(given, wanted), lambda k: _found("caption.extra", k, F.lit("")))
    # Of several captions under one key the last is judged.
    last = F.filter("captions", lambda c, i: ~F.array_contains(F.slice(given, i + 2, F.size(given)), c["cap_idx"]) & F.array_contains(wanted, c["cap_idx"]))
    lacking = F.flatten(F.transform(last, lambda c: F.array_compact(F.array(*[
        F.when(blank(c, x), _found("caption.blank", c["cap_idx"], F.lit(f"missing {x}"))) for x in LANGS]))))
    every = F.concat(
        F.array_compact(F.array(*preamble)).cast(kind), missing.cast(kind), extra.cast(kind), F.coalesce(lacking.cast(kind), F.array().cast(kind)))
    return pairs.select(F.explode(every).alias("v")).select("v.*")


def _cheap(results: DataFrame, pairs: DataFrame, terms: DataFrame, snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """Violations of every rule but the locks."""
    received = results_by_position(results)
    # Ids are only unnested where the two lists differ.
    differ = pairs.where("_differ")
    stale = FP.stale_bindings(results, snapshots, manifests)
    flags = ["version_mismatch", "snapshot_stale", "binding_changed"]
    bound = stale.select(
        "chapter_id", F.explode(F.array_compact(F.array(*[F.when(F.col(f), f) for f in flags]))).alias("flag")
    ).select(
        F.lit("result.binding").alias("rule"), F.col("chapter_id").alias("path"), F.lit("").alias("id"),
        F.col("flag").alias("detail"),
    )
    return reduce(DataFrame.unionByName, [
        _in_row(pairs),
        K.check_result_ids(_placed_ids(differ, "_want"), _placed_ids(differ, "_got")),
        K.check_returned_verses(received),
        K.check_tags(received, terms),
        K.check_unknown_terms(results),
        bound,
    ])


def validate_results(
    chapters: DataFrame, results: DataFrame, terms: DataFrame, snapshots: DataFrame, manifests: DataFrame
) -> DataFrame:
    """Violations (rule, path, id, detail) of all results; ``path`` is the chapter id.

    Verse, preamble and caption coverage, kana, tags, unknown terms, locked renderings in
    all three kinds of text, and the binding to snapshot and source.  A chapter passes when
    it has a result and no row here.
    """
    return _cheap(results, cut_lineage(_pairs(chapters, results)), terms, snapshots, manifests).unionByName(
        K.check_locks(paired_records(chapters, results), terms, term_forms(terms)))


def refused(
    chapters: DataFrame, results: DataFrame, terms: DataFrame, snapshots: DataFrame, manifests: DataFrame
) -> DataFrame:
    """Ids of the chapters whose result breaks any rule.

    Locked renderings, the one rule that walks all text, are only checked where no other
    rule has refused the chapter.  Ids decide which results and chapters are read for it, so
    text that no rule asks for stays where it lies.
    """
    pairs = cut_lineage(_pairs(chapters, results))
    early = cut_lineage(_cheap(results, pairs, terms, snapshots, manifests).select(F.col("path").alias("chapter_id")).distinct())
    left = results.join(small_ids(early), "chapter_id", "left_anti")
    ids = small_ids(left.select(F.col("chapter_id").alias("id")).distinct())
    asked = chapters.join(ids, "id", "left_semi")
    late = K.check_locks(paired_records(asked, left), terms, term_forms(terms)).select(F.col("path").alias("chapter_id"))
    return early.unionByName(late.distinct())


def paired_records(chapters: DataFrame, results: DataFrame) -> DataFrame:
    """(chapter_id, label, en, languages): English of every source record beside what came back for it.

    Verses are paired by position, captions by key, of several under one key the last.  English
    and result of a chapter meet once, in one row; records are paired inside it.
    """
    none = F.array().cast("array<struct<key:string,en:string>>")

    def captions_of(v: Column) -> Column:
        return F.coalesce(F.array_compact(F.transform(v["images"], lambda im, k: F.when(
            is_filled(im["caption"]["en"]), F.struct(caption_key(v["id"], k).alias("key"), im["caption"]["en"].alias("en"))))), none)

    english = chapters.select(
        F.col("id").alias("chapter_id"), F.col("preamble.en").alias("_pre"), F.transform("verses", lambda v: v["en"]).alias("_verses"),
        F.flatten(F.transform("verses", captions_of)).alias("_keys"))
    texts = lambda r: F.struct(*[r[x].alias(x) for x in LANGS])
    back = results.select("chapter_id", "preamble", F.transform("verses", texts).alias("verses"), "captions")
    kind = "array<struct<label:string,en:string," + ",".join(f"{x}:string" for x in LANGS) + ">>"
    empty = F.array().cast(kind)

    def record(label: Column, en: Column, r: Column) -> Column:
        return F.struct(label.alias("label"), en.alias("en"), *[r[x].alias(x) for x in LANGS])

    both = F.when(F.col("verses").isNotNull(), F.slice("_verses", 1, F.least(F.size("_verses"), F.size("verses"))))
    verses = F.transform(both, lambda en, i: record(F.concat(F.lit("verse "), (i + 1).cast("string")), en, F.get("verses", i)))

    def caption(k: Column) -> Column:
        own = F.filter("captions", lambda c: c["cap_idx"] == k["key"])
        return F.when(F.size(own) > 0, record(F.concat(F.lit("caption "), k["key"]), k["en"], F.get(own, F.size(own) - 1)))

    preamble = F.when(F.col("preamble").isNotNull(), F.array(record(F.lit("preamble"), F.col("_pre"), F.col("preamble"))).cast(kind))
    every = F.concat(
        F.coalesce(preamble, empty), F.coalesce(verses.cast(kind), empty),
        F.coalesce(F.array_compact(F.transform("_keys", caption)).cast(kind), empty))
    rows = english.join(back, "chapter_id").select("chapter_id", once(every).alias("_every"))
    return rows.select("chapter_id", F.explode("_every").alias("r")).select("chapter_id", "r.*")
