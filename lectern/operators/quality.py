"""Data-quality rules.  Each gives violations (rule, path, id, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import (
    LANGS,
    has_kana,
    is_blank,
    is_chapter_id,
    is_filled,
    is_verse_id,
    quote_pattern,
)
from lectern.operators.joins import coverage_diff, order_mismatch
from lectern.operators.merge import BASE_SOURCE, OVERLAY_SOURCE
from lectern.operators.sizing import small_side
from lectern.operators.terms import token_runs

# Required keys and allowed values of the documents.
BOOK_FIELDS = ("slug", "title", "chapter_count")
PLATE_FIELDS = ("id", "title")
PLATE_COUNT = 97
TERM_FIELDS = (
    "term", "slug", "category", "translit", "source_def", "source_def_literal",
    "editor_note", "appears_in", "cross_refs", "locked", "first_seen",
)
TERM_CATEGORIES = ("name", "term")
LEXICON_FIELDS = ("en", "category", "zh_hant", "zh_hans", "ja")
LEXICON_CATEGORIES = ("verb", "phrase")
CHAPTER_FIELDS = ("id", "book", "chapter", "title", "preamble", "verses")
I18N_FIELDS = ("en", "zh_hant", "zh_hans", "ja")
MAX_IMAGES = 9


def _row(rule: str, path: Column, ident: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"), path.cast("string").alias("path"),
        F.coalesce(ident.cast("string"), F.lit("")).alias("id"), detail.alias("detail"),
    )


def _violations(rows: DataFrame, *checks: Column) -> DataFrame:
    """One pass: every check gives a violation struct or null."""
    found = F.array_compact(F.array(*checks))
    return rows.select(F.explode(found).alias("v")).select("v.*")


def missing_fields(raw: Column, required: Sequence[str]) -> Column:
    """Required keys absent from a JSON object, in the order required."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(k) for k in required]), keys)


def _missing(rule: str, raw: Column, required: Sequence[str], path: Column, ident: Column) -> Column:
    absent = missing_fields(raw, required)
    return F.when(
        F.size(absent) > 0,
        _row(rule, path, ident, F.concat(F.lit("missing "), F.array_join(absent, ","))),
    )


def _kind(raw: Column, path: str) -> Column:
    """VOID when JSON null, SQL null when the key is absent."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), path, "variant"))


def _text(raw: Column, path: str) -> Column:
    return F.get_json_object(raw, path)


def is_json_object(raw: Column) -> Column:
    """The whole text is one JSON object.

    The JSON reader stops after the first value, so the text is tried inside an array and
    inside an object: left-over text breaks at least one of the two.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"x":'), raw, F.lit("}")))
    kind = F.schema_of_variant(F.try_variant_get(in_array, "$[0]", "variant"))
    return F.coalesce(in_object.isNotNull() & kind.startswith("OBJECT"), F.lit(False))


def check_books(raws: DataFrame) -> DataFrame:
    """(path, raw): required keys; chapter_count must be an integer."""
    raw, path = F.col("raw"), F.col("path")
    kind = _kind(raw, "$.chapter_count")
    return _violations(
        raws,
        _missing("books.required", raw, BOOK_FIELDS, path, _text(raw, "$.slug")),
        F.when(
            kind.isNotNull() & ~kind.isin("BIGINT", "BOOLEAN"),
            _row("books.chapter_count", path, _text(raw, "$.slug"), F.lit("not an integer")),
        ),
    )


def check_plates(raws: DataFrame, expected: int = PLATE_COUNT) -> DataFrame:
    raw, path = F.col("raw"), F.col("path")
    fields = _violations(
        raws, _missing("plates.required", raw, PLATE_FIELDS, path, _text(raw, "$.id"))
    )
    total = raws.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected).select(
        F.lit("plates.count").alias("rule"), F.lit("plates").alias("path"), F.lit("").alias("id"),
        F.concat(F.lit(f"expected {expected}, got "), F.col("n").cast("string")).alias("detail"),
    )
    return fields.unionByName(total)


def _bad_category(rule: str, raw: Column, path: Column, ident: Column, allowed: Sequence[str]) -> Column:
    value = _text(raw, "$.category")
    return F.when(
        value.isNull() | ~value.isin(*allowed),
        _row(rule, path, ident, F.concat(F.lit("bad category "), F.coalesce(value, F.lit("null")))),
    )


def check_terms(raws: DataFrame) -> DataFrame:
    raw, path = F.col("raw"), F.col("path")
    slug = _text(raw, "$.slug")
    rows = _violations(
        raws,
        _missing("terms.required", raw, TERM_FIELDS, path, slug),
        _bad_category("terms.category", raw, path, slug, TERM_CATEGORIES),
    )
    repeated = raws.groupBy(slug.alias("slug")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("terms.duplicate").alias("rule"), F.lit("terms").alias("path"),
        F.coalesce("slug", F.lit("")).alias("id"),
        F.concat(F.lit("repeated "), (F.col("n") - 1).cast("string")).alias("detail"),
    )
    return rows.unionByName(repeated)


def check_lexicon(raws: DataFrame) -> DataFrame:
    raw, path = F.col("raw"), F.col("path")
    en = _text(raw, "$.en")
    return _violations(
        raws,
        _missing("lexicon.required", raw, LEXICON_FIELDS, path, en),
        _bad_category("lexicon.category", raw, path, en, LEXICON_CATEGORIES),
    )


def check_chapters(raws: DataFrame) -> DataFrame:
    """(path, raw): parseable, required keys, id form, verses array, preamble, provenance."""
    raw, path = F.col("raw"), F.col("path")
    ident = _text(raw, "$.id")
    ok = is_json_object(raw)
    verses, preamble = _kind(raw, "$.verses"), _kind(raw, "$.preamble")
    source = _text(raw, "$.preamble_source")
    has_source = F.array_contains(
        F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), "preamble_source"
    )
    pre_missing = missing_fields(_text(raw, "$.preamble"), I18N_FIELDS)
    is_void = F.coalesce(preamble == "VOID", F.lit(True))
    return _violations(
        raws,
        F.when(~ok, _row("chapter.json", path, F.lit(""), F.lit("not a JSON object"))),
        F.when(ok, _missing("chapter.required", raw, CHAPTER_FIELDS, path, ident)),
        F.when(
            ok & ~F.coalesce(is_chapter_id(ident), F.lit(False)),
            _row("chapter.id", path, ident, F.lit("bad chapter id")),
        ),
        F.when(
            ok & verses.isNotNull() & ~verses.startswith("ARRAY"),
            _row("chapter.verses", path, ident, F.lit("verses must be an array")),
        ),
        F.when(
            ok & ~is_void & ~preamble.startswith("OBJECT"),
            _row("preamble.shape", path, ident, F.lit("preamble must be an object")),
        ),
        F.when(
            ok & ~is_void & preamble.startswith("OBJECT") & (F.size(pre_missing) > 0),
            _row("preamble.keys", path, ident,
                 F.concat(F.lit("missing "), F.array_join(pre_missing, ","))),
        ),
        F.when(
            ok & ~has_source, _row("preamble.source", path, ident, F.lit("missing preamble_source"))
        ),
        F.when(
            ok & has_source & source.isNotNull() & ~source.isin(BASE_SOURCE, OVERLAY_SOURCE),
            _row("preamble.source", path, ident, F.concat(F.lit("bad preamble_source "), source)),
        ),
    )


def check_verses(verses: DataFrame) -> DataFrame:
    """Verse id form; English must not be null or ''."""
    path = F.col("chapter_id")
    return _violations(
        verses,
        F.when(
            ~F.coalesce(is_verse_id(F.col("verse_id")), F.lit(False)),
            _row("verse.id", path, F.col("verse_id"), F.lit("bad verse id")),
        ),
        F.when(
            ~is_filled(F.col("en")), _row("verse.en", path, F.col("verse_id"), F.lit("no English"))
        ),
    )


def check_images(images: DataFrame, inventory: DataFrame) -> DataFrame:
    """(chapter_id, verse_id, raw image JSON): caption shape; the file must exist."""
    raw = F.col("raw")
    kind = _kind(raw, "$.caption")
    shape = _violations(
        images,
        F.when(
            kind.isNotNull() & (kind != "VOID") & ~kind.startswith("OBJECT"),
            _row("image.caption", F.col("chapter_id"), F.col("verse_id"),
                 F.lit("caption must be an object")),
        ),
    )
    files = images.withColumn("file", F.element_at(F.split(_text(raw, "$.src"), "/"), -1)).where(
        is_filled(F.col("file"))
    )
    absent = files.join(inventory.select("file").distinct(), "file", "left_anti").select(
        F.lit("image.file").alias("rule"), F.col("chapter_id").alias("path"),
        F.col("verse_id").alias("id"), F.concat(F.lit("missing "), "file").alias("detail"),
    )
    return shape.unionByName(absent)


def check_result_coverage(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Verses of a result: exact ids in exact order, all languages non-blank.

    Both sides have (chapter_id, ord, verse_id); ``received`` also the languages.
    """
    return check_result_ids(expected, received).unionByName(_violations(received, blank_verse()))


def check_result_ids(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Ids missing, foreign, repeated or out of place."""
    order = order_mismatch(expected, received, "chapter_id", "verse_id").where("n_different > 0").select(
        F.lit("result.order").alias("rule"), F.col("chapter_id").alias("path"), F.lit("").alias("id"),
        F.concat(F.col("n_different").cast("string"), F.lit(" positions differ")).alias("detail"),
    )
    ids = coverage_diff(expected, received, "chapter_id", "verse_id").where("status <> 'ok'").select(
        F.concat(F.lit("result."), "status").alias("rule"), F.col("chapter_id").alias("path"),
        F.col("verse_id").alias("id"),
        F.concat(F.col("n_received").cast("string"), F.lit(" of "),
                 F.col("n_expected").cast("string")).alias("detail"),
    )
    return order.unionByName(ids)


def blank_verse() -> Column:
    """Violation of a returned verse that is blank in some language."""
    first_blank = F.coalesce(*[F.when(is_blank(F.col(lang)), lang) for lang in LANGS])
    return F.when(
        first_blank.isNotNull(),
        _row("result.blank", F.col("chapter_id"), F.col("verse_id"), F.concat(F.lit("missing "), first_blank)),
    )


def kana_verse() -> Column:
    """Violation of a returned verse with kana in a Chinese field."""
    where = F.when(has_kana(F.col("zh_hant")), "zh_hant").when(has_kana(F.col("zh_hans")), "zh_hans")
    return F.when(where.isNotNull(), _row("result.kana", F.col("chapter_id"), F.col("verse_id"), where))


def check_kana(received: DataFrame) -> DataFrame:
    """Kana in a Chinese field, one violation per verse."""
    return _violations(received, kana_verse())


def check_returned_verses(received: DataFrame) -> DataFrame:
    """Blank languages and kana of returned verses, in one pass."""
    return _violations(received, blank_verse(), kana_verse())


def check_preamble_coverage(chapters: DataFrame, results: DataFrame) -> DataFrame:
    """A source preamble needs all languages in the result."""
    joined = results.select("chapter_id", "preamble").join(
        chapters.where(is_filled(F.col("preamble.en"))).select(F.col("id").alias("chapter_id")),
        "chapter_id",
    )
    return joined.select(
        "chapter_id",
        F.explode(F.array(*[
            F.struct(F.lit(x).alias("lang"), F.col(f"preamble.{x}").alias("t")) for x in LANGS
        ])).alias("p"),
    ).where(is_blank(F.col("p.t"))).select(
        F.lit("result.preamble").alias("rule"), F.col("chapter_id").alias("path"),
        F.lit("preamble").alias("id"), F.concat(F.lit("missing "), F.col("p.lang")).alias("detail"),
    )


def check_caption_coverage(captions: DataFrame, received: DataFrame) -> DataFrame:
    """Captions by stable key: exact set, all languages.  Only returned chapters count.

    Several rows for one key are one caption: the last (by ``pos``) is the one judged.
    """
    last = received.groupBy("chapter_id", "cap_idx").agg(
        F.max_by(F.struct(*LANGS), F.col("pos")).alias("_r")
    ).select("chapter_id", "cap_idx", *[F.col(f"_r.{x}").alias(x) for x in LANGS])
    sets = coverage_diff(captions, last, "chapter_id", "cap_idx").where(
        F.col("status").isin("missing", "extra")
    ).select(
        F.concat(F.lit("caption."), "status").alias("rule"), F.col("chapter_id").alias("path"),
        F.col("cap_idx").alias("id"), F.lit("").alias("detail"),
    )
    wanted = last.join(captions.select("chapter_id", "cap_idx"), ["chapter_id", "cap_idx"], "left_semi")
    blank = wanted.select(
        "chapter_id", "cap_idx",
        F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.col(x).alias("t")) for x in LANGS])).alias("p"),
    ).where(is_blank(F.col("p.t"))).select(
        F.lit("caption.blank").alias("rule"), F.col("chapter_id").alias("path"),
        F.col("cap_idx").alias("id"), F.concat(F.lit("missing "), F.col("p.lang")).alias("detail"),
    )
    return sets.unionByName(blank)


def check_tags(received: DataFrame, terms: DataFrame) -> DataFrame:
    """Tags must be headwords (any case) or slugs of the snapshot."""
    tags = received.select("chapter_id", "verse_id", F.explode("glossary_terms").alias("tag"))
    known = terms.select(F.lower("term").alias("_k")).distinct()
    slugs = terms.select(F.col("slug").alias("_k")).distinct()
    return tags.join(known, F.lower("tag") == F.col("_k"), "left_anti").join(
        slugs, F.col("tag") == F.col("_k"), "left_anti"
    ).select(
        F.lit("result.tag").alias("rule"), F.col("chapter_id").alias("path"),
        F.col("verse_id").alias("id"), F.concat(F.lit("unknown "), "tag").alias("detail"),
    )


def check_unknown_terms(results: DataFrame) -> DataFrame:
    return _violations(
        results,
        F.when(
            F.coalesce(F.size("unknown_terms") > 0, F.lit(False)),
            _row("result.unknown_terms", F.col("chapter_id"), F.lit(""),
                 F.array_join(F.array_sort("unknown_terms"), ",")),
        ),
    )


def check_locks(
    records: DataFrame, terms: DataFrame, forms: DataFrame
) -> DataFrame:
    """Every term standing in the English must be rendered as locked, per language.

    ``records`` has (chapter_id, label, en, zh_hant, zh_hans, ja).  The translations ride
    along with the token runs and are judged there, so nothing large is joined back or shuffled.
    """
    runs = token_runs(records, "en", ["chapter_id", "label"], forms, carried=list(LANGS))
    locked = terms.select("slug", F.col("term").alias("_term"), F.col("translit").alias("_tl"))
    checks = runs.join(small_side(locked), "slug").select(
        "chapter_id", "label", "slug", "_term",
        F.explode(F.array(*[
            F.struct(F.lit(x).alias("lang"), F.col(f"_tl.{x}").alias("want"), F.col(x).alias("got"))
            for x in LANGS
        ])).alias("c"),
    )
    # A term may stand in a text several times and in several forms: one violation per language.
    return checks.where(
        is_filled(F.col("c.want"))
        & ~F.contains(F.coalesce(F.col("c.got"), F.lit("")), F.col("c.want"))
    ).select(
        "chapter_id", "label", "slug", "_term", F.col("c.lang").alias("lang"), F.col("c.want").alias("want")
    ).dropDuplicates().select(
        F.lit("result.lock").alias("rule"), F.col("chapter_id").alias("path"),
        F.col("label").alias("id"),
        F.concat("lang", F.lit(" missing "), "_term", F.lit("→"), "want").alias("detail"),
    )


def check_tagged_locks(verses: DataFrame, terms: DataFrame, gate: bool = True) -> DataFrame:
    """Older rule: only exact tags, gated by ``\\b term \\b`` in the English when known.

    ``verses`` has (chapter_id, verse_id, en, languages, glossary_terms).
    """
    locked = terms.groupBy(F.col("term").alias("_tag")).agg(
        F.max_by("translit", F.col("position")).alias("_tl")
    )
    tags = verses.select(
        "chapter_id", "verse_id", "en", *LANGS, F.explode(F.array_distinct("glossary_terms")).alias("_tag")
    ).join(locked, "_tag")
    if gate:
        pattern = F.concat(F.lit(r"(?iU)\b"), quote_pattern(F.col("_tag")), F.lit(r"\b"))
        tags = tags.where(F.rlike(F.coalesce("en", F.lit("")), pattern))
    checks = tags.select(
        "chapter_id", "verse_id", "_tag",
        F.explode(F.array(*[
            F.struct(F.lit(x).alias("lang"), F.col(f"_tl.{x}").alias("want"), F.col(x).alias("got"))
            for x in LANGS
        ])).alias("c"),
    )
    return checks.where(
        is_filled(F.col("c.want"))
        & ~F.contains(F.coalesce(F.col("c.got"), F.lit("")), F.col("c.want"))
    ).select(
        F.lit("result.tagged_lock").alias("rule"), F.col("chapter_id").alias("path"),
        F.col("verse_id").alias("id"),
        F.concat(F.col("c.lang"), F.lit(" missing "), F.col("_tag"), F.lit("→"), F.col("c.want")).alias("detail"),
    )


def check_image_pileup(verses: DataFrame, limit: int = MAX_IMAGES) -> DataFrame:
    n = F.coalesce(F.size("images"), F.lit(0))
    return _violations(
        verses,
        F.when(n > limit, _row("verse.images", F.col("chapter_id"), F.col("verse_id"),
                               F.concat(n.cast("string"), F.lit(" images")))),
    )


def check_expected_images(expected: DataFrame, verses: DataFrame) -> DataFrame:
    """(verse_id, src) pairs that must be there and are not."""
    have = verses.select("verse_id", F.explode("images.src").alias("src")).distinct()
    return expected.join(have, ["verse_id", "src"], "left_anti").select(
        F.lit("verse.expected_image").alias("rule"), F.lit("").alias("path"),
        F.col("verse_id").alias("id"), F.concat(F.lit("missing "), "src").alias("detail"),
    )


def review_gate(reviews: DataFrame) -> DataFrame:
    """Pass exactly when no issue is major; minors do not block."""
    issues = F.coalesce(F.col("issues"), F.array().cast(reviews.schema["issues"].dataType))
    return reviews.select(
        "chapter_id",
        (~F.exists(issues, lambda i: F.coalesce(i["severity"] == "major", F.lit(False)))).alias("passed"),
        F.size(F.filter(issues, lambda i: i["severity"] == "major")).alias("n_major"),
        F.size(issues).alias("n_issues"),
    )


def check_identity(verses: DataFrame) -> DataFrame:
    """Repeated verse ids and numbering that leaves the dense 1..n."""
    repeated = verses.groupBy("verse_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("identity.duplicate").alias("rule"), F.lit("").alias("path"),
        F.col("verse_id").alias("id"), F.concat(F.col("n").cast("string"), F.lit(" times")).alias("detail"),
    )
    gaps = _violations(
        verses,
        F.when(
            ~F.col("verse_number").eqNullSafe(F.col("ord")),
            _row("identity.numbering", F.col("chapter_id"), F.col("verse_id"),
                 F.concat(F.lit("at position "), F.col("ord").cast("string"))),
        ),
    )
    return repeated.unionByName(gaps)


def summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def sample_errors(violations: DataFrame, group: str, k: int = 5) -> DataFrame:
    """First ``k`` ids per group in order, joined, with the total.

    The ranked filter becomes a per-task top-k before the shuffle, so a group with a third
    of all rows sends only k rows per task.
    """
    thin = top_rows(violations, [group], [F.col("id"), F.col("detail")], k)
    totals = violations.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    first = thin.groupBy(group).agg(
        F.array_join(F.slice(F.array_sort(F.collect_list("id")), 1, k), ",").alias("sample")
    )
    return totals.join(first, group)


def top_rows(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Top ``k`` rows per group; Spark keeps only k rows per group before shuffling."""
    w = W.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
