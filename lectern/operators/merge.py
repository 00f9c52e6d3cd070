"""Upserts.  Null and '' are told apart on purpose, rule by rule.

=====================  ==========================  =====================================
rule                   what counts as missing      who wins when both sides have a value
=====================  ==========================  =====================================
fill_nulls             null only ('' is kept)      the old value
fill_blank             null and ''                 the old value
overwrite_nonblank     (new side) null and ''      the new value
=====================  ==========================  =====================================
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import (
    LANGS,
    blank_to_null,
    has_katakana,
    is_filled,
)
from lectern.operators.sizing import small_ids
from lectern.session import cut_lineage

# Provenance tags stored in the documents.
BASE_SOURCE = "word-1882"
OVERLAY_SOURCE = "sacred-texts"

# The groups of a term that a delta may fill, and their sub-fields.
TERM_GROUPS = {
    "translit": ("zh_hant", "zh_hans", "ja"),
    "source_def_literal": ("zh_hant", "zh_hans", "ja"),
    "editor_note": ("en", "zh_hant", "zh_hans", "ja"),
}


def fill_nulls(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def fill_blank(old: Column, new: Column) -> Column:
    return F.coalesce(blank_to_null(old), blank_to_null(new), old)


def overwrite_nonblank(old: Column, new: Column) -> Column:
    return F.coalesce(blank_to_null(new), old)


# --- overlay --------------------------------------------------------------------------


def overlay_preamble(chapters: DataFrame, overlay: DataFrame) -> DataFrame:
    """Precedence fill of the English preamble; ``overlay`` has (book, chapter, epigraph).

    Tagged chapters stay as they are; untagged English is tagged as base; an empty
    preamble takes the overlay text, or '' and no tag.  Translations are never touched.
    Chapters that have no overlay row at all are left alone (outcome ``untouched``).
    """
    side = overlay.select("book", "chapter", "epigraph", F.lit(True).alias("_has"))
    joined = chapters.join(side, ["book", "chapter"], "left")
    tag, english = F.col("preamble_source"), F.col("preamble.en")
    found = is_filled(F.col("epigraph"))
    outcome = (
        F.when(F.col("_has").isNull(), "untouched")
        .when(tag == BASE_SOURCE, "kept")
        .when(tag == OVERLAY_SOURCE, "already_filled")
        .when(is_filled(english) & tag.isNull(), "kept")
        .when(found, "filled")
        .otherwise("empty")
    )
    tagged = tag.isin(BASE_SOURCE, OVERLAY_SOURCE)
    leave = F.col("_has").isNull() | F.coalesce(tagged, F.lit(False))
    new_tag = (
        F.when(leave, tag)
        .when(is_filled(english) & tag.isNull(), BASE_SOURCE)
        .when(found, OVERLAY_SOURCE)
    )
    new_en = (
        F.when(leave, english)
        .when(is_filled(english) & tag.isNull(), english)
        .when(found, F.col("epigraph"))
        .otherwise("")
    )
    merged = joined.select(
        *[c for c in chapters.columns if c not in ("preamble", "preamble_source")],
        F.struct(
            new_en.alias("en"), *[F.col(f"preamble.{lang}").alias(lang) for lang in LANGS]
        ).alias("preamble"),
        new_tag.alias("preamble_source"),
        outcome.alias("outcome"),
        (~new_en.eqNullSafe(english) | ~new_tag.eqNullSafe(tag)).alias("changed"),
    )
    return merged


def absent_targets(overlay: DataFrame, chapters: DataFrame) -> DataFrame:
    return overlay.join(chapters.select("book", "chapter"), ["book", "chapter"], "left_anti")


def outcome_report(merged: DataFrame, column: str = "outcome") -> DataFrame:
    return merged.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


# --- verse translations ---------------------------------------------------------------


def results_by_position(results: DataFrame) -> DataFrame:
    """Returned verses with their position, which pairs them with the source verses."""
    return results.select(
        "chapter_id", F.posexplode("verses").alias("_i", "v")
    ).select(
        "chapter_id", (F.col("_i") + 1).alias("ord"), F.col("v.id").alias("verse_id"),
        *[F.col(f"v.{lang}").alias(lang) for lang in LANGS],
        F.col("v.glossary_terms").alias("glossary_terms"),
    )


def merge_chapters(
    chapters: DataFrame, results: DataFrame, manifest: DataFrame, failed: DataFrame,
    live: DataFrame,
) -> DataFrame:
    """Fill-only merge of whole chapter results, all or nothing per chapter.

    ``results`` are nested rows, ``manifest`` and ``live`` hold (chapter_id, src_sha) as
    recorded and as they are now, ``failed`` the chapter ids that did not pass validation.
    A validated result lists the same verses in the same order as the source, so both
    arrays are zipped inside the chapter row; captions are matched by their stable key.
    Adds ``verses_merged``, ``skipped_nonnull``, ``captions_merged``.
    """
    # Which results fit is settled on ids; then only the chapters they fit move, with their results.
    passed = small_ids(cut_lineage(
        results.select("chapter_id").join(failed.select("chapter_id").distinct(), "chapter_id", "left_anti").distinct()))
    then = manifest.select("chapter_id", F.col("src_sha").alias("_then")).join(passed, "chapter_id", "left_semi")
    now = live.select("chapter_id", F.col("src_sha").alias("_now")).join(passed, "chapter_id", "left_semi")
    ids = small_ids(cut_lineage(
        then.join(now, "chapter_id").where(F.col("_then").eqNullSafe(F.col("_now"))).select(F.col("chapter_id").alias("_id")).distinct()))
    fit = results.join(ids, results["chapter_id"] == ids["_id"], "left_semi").select(
        F.col("chapter_id").alias("_id"), F.col("verses").alias("_rv"),
        F.col("preamble").alias("_rp"), F.col("captions").alias("_rc"),
    )
    lone = [F.lit(None).cast(f.dataType).alias(f.name) for f in fit.schema]
    same = chapters["id"] == ids["_id"]
    joined = chapters.join(ids, same, "left_semi").join(fit, F.col("id") == F.col("_id")).unionByName(
        chapters.join(ids, same, "left_anti").select("*", *lone))
    hit = F.col("_id").isNotNull()
    image = chapters.schema["verses"].dataType.elementType["images"].dataType

    def result_caption(v: Column, i: Column) -> Column:
        key = F.concat(v["id"], F.lit("#"), i.cast("string"))
        return F.get(F.filter(F.col("_rc"), lambda c: c["cap_idx"] == key), F.lit(0))

    def merged_image(v: Column, im: Column, i: Column) -> Column:
        new = result_caption(v, i)
        caption = F.when(
            im["caption"].isNotNull(),
            F.struct(
                im["caption"]["en"].alias("en"),
                *[fill_blank(im["caption"][lang], new[lang]).alias(lang) for lang in LANGS],
            ),
        )
        return F.struct(im["src"].alias("src"), im["edition"].alias("edition"),
                        caption.alias("caption"))

    def merged_verse(v: Column, r: Column) -> Column:
        tags = F.when(
            r["glossary_terms"].isNotNull() & ~F.coalesce(F.size(v["glossary_terms"]) > 0, F.lit(False)),
            r["glossary_terms"],
        ).otherwise(v["glossary_terms"])
        fields = []
        for name in VERSE_FIELDS:
            if name in LANGS:
                fields.append(fill_blank(v[name], r[name]).alias(name))
            elif name == "glossary_terms":
                fields.append(tags.alias(name))
            elif name == "images":
                fields.append(
                    F.transform(v["images"], lambda im, i: merged_image(v, im, i)).cast(image).alias(name)
                )
            else:
                fields.append(v[name].alias(name))
        return F.struct(*fields)

    VERSE_FIELDS = chapters.schema["verses"].dataType.elementType.names

    def count(cond) -> Column:
        pairs = F.zip_with("verses", "_rv", lambda v, r: cond(v, r).cast("int"))
        return F.when(hit, F.aggregate(pairs, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))).otherwise(0)

    skipped = sum(
        (count(lambda v, r, lang=lang: is_filled(v[lang]) & is_filled(r[lang])) for lang in LANGS),
        F.lit(0),
    )
    matched_captions = F.when(
        hit,
        F.aggregate(
            F.col("verses"), F.lit(0),
            lambda n, v: n + F.size(
                F.filter(
                    F.coalesce(v["images"], F.array().cast(image)),
                    lambda im, i: im["caption"].isNotNull() & result_caption(v, i).isNotNull(),
                )
            ),
        ),
    ).otherwise(0)
    preamble = F.when(
        hit & F.col("preamble").isNotNull(),
        F.struct(
            F.col("preamble.en").alias("en"),
            *[fill_blank(F.col(f"preamble.{lang}"), F.col(f"_rp.{lang}")).alias(lang) for lang in LANGS],
        ),
    ).otherwise(F.col("preamble"))
    verses = F.when(hit, F.zip_with("verses", "_rv", merged_verse)).otherwise(F.col("verses"))
    return joined.select(
        *[c for c in chapters.columns if c not in ("preamble", "verses")],
        preamble.alias("preamble"),
        verses.alias("verses"),
        hit.alias("merged"),
        F.when(hit, F.size("_rv")).otherwise(0).alias("verses_merged"),
        skipped.alias("skipped_nonnull"),
        matched_captions.alias("captions_merged"),
    )


def overwrite_verses(verses: DataFrame, received: DataFrame) -> DataFrame:
    """Older rule: returned text replaces; returned tags replace when not null.

    ``received`` has one row per (chapter_id, verse_id); several rows for one verse apply
    in order of ``ord``, so the last non-blank text and the last non-null tags win.
    """
    last = received.groupBy("chapter_id", "verse_id").agg(
        *[
            F.max_by(lang, F.when(is_filled(F.col(lang)), F.col("ord"))).alias(f"_n_{lang}")
            for lang in LANGS
        ],
        F.max_by("glossary_terms", F.when(F.col("glossary_terms").isNotNull(), F.col("ord"))).alias(
            "_n_tags"
        ),
    )
    joined = verses.join(last, ["chapter_id", "verse_id"], "left")
    out = joined
    for lang in LANGS:
        out = out.withColumn(lang, overwrite_nonblank(F.col(lang), F.col(f"_n_{lang}")))
    return out.withColumn("glossary_terms", F.coalesce("_n_tags", "glossary_terms")).drop(
        *[f"_n_{lang}" for lang in LANGS], "_n_tags"
    )


def match_captions(captions: DataFrame, received: DataFrame) -> DataFrame:
    """Caption translations by (verse, English), else by verse when it has one caption.

    ``received`` has (verse_id, en, zh_hant, zh_hans, ja, pos).  Among equal keys the last
    exact match wins; the fallback takes the first row of the verse.
    """
    texts = F.struct(*LANGS)
    exact = received.where(is_filled(F.col("en"))).groupBy("verse_id", "en").agg(
        F.max_by(texts, F.col("pos")).alias("_exact")
    )
    by_verse = received.groupBy("verse_id").agg(F.min_by(texts, F.col("pos")).alias("_any"))
    counts = captions.groupBy("chapter_id", "verse_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = (
        captions.join(counts, ["chapter_id", "verse_id"])
        .join(exact, ["verse_id", "en"], "left")
        .join(by_verse, "verse_id", "left")
    )
    new = F.coalesce(F.col("_exact"), F.when(F.col("_n") == 1, F.col("_any")))
    out = joined.withColumn("_new", new).withColumn("matched", F.col("_new").isNotNull())
    for lang in LANGS:
        out = out.withColumn(lang, fill_blank(F.col(lang), F.col(f"_new.{lang}")))
    return out.drop("_new", "_exact", "_any", "_n")


def pair_with_source(received: DataFrame, verses: DataFrame) -> DataFrame:
    """Each returned verse with its English; an unknown id has no English."""
    source = verses.select("verse_id", F.col("en").alias("_en"), "ord", "chapter_id")
    last = source.groupBy("verse_id").agg(F.max_by("_en", F.struct("chapter_id", "ord")).alias("en"))
    return received.join(last, "verse_id", "left")


def inject_images(verses: DataFrame, images: DataFrame) -> DataFrame:
    """Append images to one verse, skipping sources it already shows; text is untouched.

    ``images`` has (book, chapter, verse_number, pos, src, edition, caption).  Only the
    first verse of a chapter carrying the number receives them.
    """
    kind = verses.schema["images"].dataType
    image = F.struct("pos", F.struct("src", "edition", "caption").alias("im"))
    new = images.groupBy("book", "chapter", "verse_number").agg(
        F.transform(F.array_sort(F.collect_list(image)), lambda p: p["im"]).cast(kind).alias("_new")
    )
    first = verses.join(
        new.select("book", "chapter", "verse_number"), ["book", "chapter", "verse_number"], "left_semi"
    ).groupBy("book", "chapter", "verse_number").agg(F.min("ord").alias("ord"))
    target = new.join(first, ["book", "chapter", "verse_number"]).drop("verse_number")
    joined = verses.join(target, ["book", "chapter", "ord"], "left")
    have = F.coalesce(F.col("images"), F.array().cast(kind))
    srcs = F.transform(have, lambda im: im["src"])
    add = F.filter("_new", lambda im: ~F.array_contains(srcs, im["src"]))
    return joined.withColumn(
        "images", F.when(F.col("_new").isNotNull(), F.concat(have, add)).otherwise(F.col("images"))
    ).drop("_new")


# --- dictionaries ---------------------------------------------------------------------


def _leaves() -> list[tuple[str, str]]:
    return [(group, sub) for group, subs in TERM_GROUPS.items() for sub in subs]


def coin_or_fill(terms: DataFrame, delta: DataFrame, scope: str = "chapter_id") -> DataFrame:
    """Apply fills and coins in order; what exists wins, nulls are filled.

    ``delta`` has the term columns plus ``kind`` (fill / coin), ``pos`` and the ``scope``
    column naming the chapter.  For a new slug the first coin makes the term (fills before
    it are ignored as unknown) and later rows only fill its nulls.  Rows of one slug are
    folded per leaf with first-non-null aggregates, so many copies of a slug merge early.
    Only a fill that filled something sets ``first_seen`` and may lock a known term; a coin
    of a known slug fills nulls and changes neither.
    """
    order = F.struct("_wave", "pos")
    coin = F.col("kind") == "coin"
    # Fills come before coins, as the change set is applied in that order.
    rows = delta.withColumn("_wave", F.when(coin, 1).otherwise(0))
    known = terms.select("slug", F.lit(True).alias("_known"))
    rows = rows.join(known, "slug", "left").where(coin | F.col("_known"))

    leaf_old = {
        (g, s): F.col(f"{g}.{s}") for g, s in _leaves()
    }
    folded = rows.groupBy("slug").agg(
        *[
            F.min_by(F.col(f"{g}.{s}"), F.when(F.col(f"{g}.{s}").isNotNull(), order)).alias(f"_{g}_{s}")
            for g, s in _leaves()
        ],
        *[
            F.min(
                F.when(
                    ~coin & F.col(f"{g}.{s}").isNotNull(),
                    F.struct("pos", F.col(scope).alias("scope"), F.col(f"{g}.{s}").alias("value")),
                )
            ).alias(f"_fill_{g}_{s}")
            for g, s in _leaves()
        ],
        *[
            F.min_by(F.col(c), F.when(coin, order)).alias(f"_coin_{c}")
            for c in ("term", "category", "source_def", "source_forms", "first_seen")
        ],
        F.min_by(F.col(scope), F.when(coin, order)).alias("_coin_scope"),
    )
    old = terms.withColumn("_old", F.lit(True))
    joined = old.join(folded, "slug", "full_outer")
    is_new = F.col("_old").isNull()
    filled = F.array_compact(
        F.array(
            *[
                F.when(leaf_old[g, s].isNull() & F.col(f"_{g}_{s}").isNotNull(), F.lit(f"{g}.{s}"))
                for g, s in _leaves()
            ]
        )
    )
    outcome = (
        F.when(is_new, "coined").when(F.size(filled) > 0, "filled").otherwise("unchanged")
    )
    groups = {
        g: F.struct(*[fill_nulls(leaf_old[g, s], F.col(f"_{g}_{s}")).alias(s) for s in subs])
        for g, subs in TERM_GROUPS.items()
    }
    # The first fill that met a null leaf, and the renderings as the fills leave them.
    first_fill = F.array_min(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        leaf_old[g, s].isNull() & F.col(f"_fill_{g}_{s}").isNotNull(),
                        F.struct(F.col(f"_fill_{g}_{s}.pos").alias("pos"),
                                 F.col(f"_fill_{g}_{s}.scope").alias("scope")),
                    )
                    for g, s in _leaves()
                ]
            )
        )
    )
    complete = F.forall(
        F.array(*[fill_nulls(leaf_old["translit", s], F.col(f"_fill_translit_{s}.value")) for s in LANGS]),
        is_filled,
    )
    first_seen = (
        F.when(is_new, F.coalesce("_coin_first_seen", "_coin_scope"))
        .when(first_fill.isNotNull(), F.coalesce(F.col("first_seen"), first_fill["scope"]))
        .otherwise(F.col("first_seen"))
    )
    locked = (
        F.when(is_new, True)
        .when(first_fill.isNotNull() & complete, True)
        .otherwise(F.col("locked"))
    )
    return joined.select(
        F.coalesce("term", "_coin_term").alias("term"), "slug",
        F.coalesce("category", "_coin_category").alias("category"),
        *[groups[g].alias(g) for g in TERM_GROUPS],
        F.coalesce("source_def", F.when(is_new, F.col("_coin_source_def"))).alias("source_def"),
        F.coalesce("source_forms", F.when(is_new, F.col("_coin_source_forms"))).alias("source_forms"),
        locked.alias("locked"), first_seen.alias("first_seen"),
        outcome.alias("outcome"),
        F.when(is_new, F.array().cast("array<string>")).otherwise(filled).alias("filled_fields"),
    )


def append_new(base: DataFrame, extra: DataFrame, key: str, order: Column) -> DataFrame:
    """Append rows with an unseen key; among new rows of one key the first wins."""
    names = [c for c in base.columns if c != key]
    fresh = extra.join(base.select(key), key, "left_anti").groupBy(key).agg(
        F.min_by(F.struct(*names), order).alias("_r")
    ).select(key, *[f"_r.{n}" for n in names])
    return base.select(key, *names).unionByName(fresh)


def union_forms(old: Column, new: Column) -> Column:
    """Sorted distinct union; nothing new leaves the old list as it is."""
    empty = F.array().cast("array<string>")
    union = F.array_sort(F.array_union(F.coalesce(old, empty), F.coalesce(new, empty)))
    return F.when(F.coalesce(F.size(new) > 0, F.lit(False)), union).otherwise(old)


def apply_in_memory(terms: DataFrame, delta: DataFrame) -> DataFrame:
    """Full term set of a snapshot: blanks filled, forms united, unknown coins added.

    Fills of one slug apply in order (first non-blank value per leaf); of several coins of
    one slug the first is taken; a coin whose slug exists changes nothing.
    """
    fills = delta.where(F.col("kind") == "fill")
    folded = fills.groupBy("slug").agg(
        *[
            F.min_by(
                F.col(f"{g}.{s}"), F.when(is_filled(F.col(f"{g}.{s}")), F.col("pos"))
            ).alias(f"_{g}_{s}")
            for g, s in _leaves()
        ],
    )
    forms = (
        fills.select("slug", F.explode("source_forms").alias("_form")).distinct()
        .groupBy("slug").agg(F.collect_set("_form").alias("_forms"))
    )
    joined = terms.join(folded, "slug", "left").join(forms, "slug", "left")
    names = [c for c in terms.columns if c != "slug"]

    def column(name: str) -> Column:
        if name in TERM_GROUPS:
            return F.struct(
                *[
                    fill_blank(F.col(f"{name}.{s}"), F.col(f"_{name}_{s}")).alias(s)
                    for s in TERM_GROUPS[name]
                ]
            ).alias(name)
        if name == "source_forms":
            return union_forms(F.col(name), F.col("_forms")).alias(name)
        return F.col(name)

    filled = joined.select("slug", *[column(n) for n in names])
    coins = delta.where(F.col("kind") == "coin").join(terms.select("slug"), "slug", "left_anti")
    given = [n for n in names if n in delta.columns]
    coined = coins.groupBy("slug").agg(
        F.min_by(F.struct(*given), F.col("pos")).alias("_r")
    ).select("slug", *[f"_r.{n}" for n in given])
    return filled.unionByName(coined, allowMissingColumns=True)


def commit_report(
    terms: DataFrame, delta: DataFrame, lexicon: DataFrame, new_lexicon: DataFrame
) -> DataFrame:
    """What a commit would do: rows (action, key, field).

    ``kept_existing``: a fill differs from a value that is set; the old value stays.
    ``conflict``: a coin or lexicon row differs from a value that is set, or from the
    first row of the same change set; with any conflict nothing may be written.
    ``filled`` / ``coined`` / ``lexicon``: accepted.
    """
    t = terms.select("slug", *TERM_GROUPS, F.lit(True).alias("_known"))
    fills = delta.where(F.col("kind") == "fill").select(
        "slug", "pos", *[F.col(g).alias(f"_n_{g}") for g in TERM_GROUPS]
    ).join(t, "slug")
    # A leaf that is still blank is set by the first fill carrying text; later fills meet it.
    firsts = fills.groupBy("slug").agg(
        *[
            F.min_by(F.col(f"_n_{g}.{s}"), F.when(is_filled(F.col(f"_n_{g}.{s}")), F.col("pos"))).alias(f"_f_{g}_{s}")
            for g, s in _leaves()
        ],
        *[
            F.min(F.when(is_filled(F.col(f"_n_{g}.{s}")), F.col("pos"))).alias(f"_p_{g}_{s}")
            for g, s in _leaves()
        ],
    )
    met = fills.join(firsts, "slug")
    kept = met.select(
        "slug",
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            F.col(f"_n_{g}.{s}").isNotNull()
                            & F.when(
                                is_filled(F.col(f"{g}.{s}")), F.col(f"{g}.{s}") != F.col(f"_n_{g}.{s}")
                            ).otherwise(
                                F.coalesce(
                                    (F.col("pos") > F.col(f"_p_{g}_{s}"))
                                    & (F.col(f"_f_{g}_{s}") != F.col(f"_n_{g}.{s}")),
                                    F.lit(False),
                                )
                            ),
                            F.lit(f"{g}.{s}"),
                        )
                        for g, s in _leaves()
                    ]
                )
            )
        ).alias("field"),
    ).select(F.lit("kept_existing").alias("action"), F.col("slug").alias("key"), "field")
    filled = fills.select(F.lit("filled").alias("action"), F.col("slug").alias("key"),
                          F.lit("").alias("field"))

    coins = delta.where(F.col("kind") == "coin").select("slug", "pos", F.col("translit").alias("_n"))
    first_coin = coins.groupBy("slug").agg(
        F.min("pos").alias("_pos"), F.min_by("_n", F.col("pos")).alias("_coin")
    )
    # A coin meets the stored term after the fills of the same change set.
    after = t.join(firsts, "slug", "left").select(
        "slug",
        F.struct(
            *[fill_blank(F.col(f"translit.{s}"), F.col(f"_f_translit_{s}")).alias(s) for s in LANGS]
        ).alias("_old"),
    )
    seen = coins.join(first_coin, "slug").join(after, "slug", "left")
    base = F.coalesce(F.col("_old"), F.when(F.col("pos") > F.col("_pos"), F.col("_coin")))
    coin_conflicts = seen.withColumn("_base", base).select(
        "slug",
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            is_filled(F.col(f"_base.{s}")) & is_filled(F.col(f"_n.{s}"))
                            & (F.col(f"_base.{s}") != F.col(f"_n.{s}")),
                            F.lit(f"translit.{s}"),
                        )
                        for s in LANGS
                    ]
                )
            )
        ).alias("field"),
    ).select(F.lit("conflict").alias("action"), F.col("slug").alias("key"), "field")
    coined = first_coin.join(terms.select("slug"), "slug", "left_anti").select(
        F.lit("coined").alias("action"), F.col("slug").alias("key"), F.lit("").alias("field")
    )

    langs = F.struct(*LANGS)
    new = new_lexicon.select("en", "pos", langs.alias("_n"))
    first_new = new.groupBy("en").agg(F.min("pos").alias("_pos"), F.min_by("_n", F.col("pos")).alias("_first"))
    old = lexicon.select("en", langs.alias("_old"))
    lex = new.join(first_new, "en").join(old, "en", "left")
    lex = lex.withColumn(
        "_base", F.coalesce(F.col("_old"), F.when(F.col("pos") > F.col("_pos"), F.col("_first")))
    )
    lex_conflicts = lex.select(
        "en",
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            is_filled(F.col(f"_base.{s}")) & is_filled(F.col(f"_n.{s}"))
                            & (F.col(f"_base.{s}") != F.col(f"_n.{s}")),
                            F.lit(f"lexicon.{s}"),
                        )
                        for s in LANGS
                    ]
                )
            )
        ).alias("field"),
    ).select(F.lit("conflict").alias("action"), F.col("en").alias("key"), "field")
    lex_new = first_new.join(lexicon.select("en"), "en", "left_anti").select(
        F.lit("lexicon").alias("action"), F.col("en").alias("key"), F.lit("").alias("field")
    )
    return (
        kept.unionByName(filled).unionByName(coin_conflicts).unionByName(coined)
        .unionByName(lex_conflicts).unionByName(lex_new)
    )


def commit(
    terms: DataFrame, delta: DataFrame, lexicon: DataFrame, new_lexicon: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, lexicon, report).  Any conflict leaves both dictionaries as they were.

    The gate is part of the plan: change rows are kept only when no conflict row exists.
    """
    report = commit_report(terms, delta, lexicon, new_lexicon)
    conflicts = report.where(F.col("action") == "conflict").agg(F.count(F.lit(1))).scalar()
    merged = apply_in_memory(terms, delta.where(conflicts == 0))
    if "locked" in merged.columns:
        touched = report.where(F.col("action").isin("filled", "coined")).groupBy(
            F.col("key").alias("slug")
        ).agg(F.bool_or(F.col("action") == "coined").alias("_coined"))
        complete = F.forall(F.array(*[F.col(f"translit.{s}") for s in LANGS]), is_filled)
        merged = merged.join(touched.where(conflicts == 0), "slug", "left").withColumn(
            "locked", F.when(F.col("_coined") | (F.col("_coined").isNotNull() & complete), True)
            .otherwise(F.col("locked")),
        ).drop("_coined")
    ok_lexicon = new_lexicon.where(conflicts == 0)
    names = [c for c in lexicon.columns if c != "en"]
    merged_lexicon = append_new(
        lexicon.select("en", *names), ok_lexicon.select("en", *names, "pos"), "en", F.col("pos")
    )
    return merged, merged_lexicon, report


def repair_leaks(verses: DataFrame, terms: DataFrame) -> DataFrame:
    """Replace a tagged term's Chinese forms inside ``ja`` by its katakana.

    Only exact headwords tagged on the verse are used, in tag order, traditional before
    simplified form.  Adds ``ja_fixed``.
    """
    ja = F.col("translit.ja")
    forms = F.filter(
        F.array(F.col("translit.zh_hant"), F.col("translit.zh_hans")),
        lambda z: is_filled(z) & (z != F.col("translit.ja")),
    )
    usable = terms.where(is_filled(ja) & has_katakana(ja)).select(
        F.col("term").alias("_tag"), forms.alias("_zh"), ja.alias("_ja"),
    ).where(F.size("_zh") > 0).groupBy("_tag").agg(F.max(F.struct("_zh", "_ja")).alias("_t"))
    key = ["chapter_id", "ord"]
    tagged = verses.where(is_filled(F.col("ja"))).select(
        *key, F.posexplode("glossary_terms").alias("_i", "_tag")
    ).join(usable, "_tag")
    pairs = tagged.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias("_pairs")
    )
    joined = verses.join(pairs, key, "left")
    flat = F.flatten(
        F.transform(
            "_pairs",
            lambda p: F.transform(p["_t"]["_zh"], lambda z: F.struct(z.alias("z"), p["_t"]["_ja"].alias("j"))),
        )
    )
    fixed = F.aggregate(flat, F.col("ja"), lambda acc, p: F.replace(acc, p["z"], p["j"]))
    new = F.when(F.col("_pairs").isNotNull(), fixed).otherwise(F.col("ja"))
    return joined.withColumn("_new", new).withColumn(
        "ja_fixed", ~F.col("_new").eqNullSafe(F.col("ja"))
    ).withColumn("ja", F.col("_new")).drop("_new", "_pairs")


def differing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys whose row is new, gone or different, judged by the digest of the row."""
    def digest(df: DataFrame) -> DataFrame:
        rest = sorted(c for c in df.columns if c not in key)
        return df.select(
            *key, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256).alias("_h")
        )

    a = digest(old).withColumnRenamed("_h", "_old")
    b = digest(new).withColumnRenamed("_h", "_new")
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .otherwise("changed")
    )
    return a.join(b, list(key), "full_outer").where(
        ~F.col("_old").eqNullSafe(F.col("_new"))
    ).select(*key, change.alias("change"))
