"""Counts, coverage, order, joins, fingerprints over the derived corpus."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.operators import fingerprint as FP
from lectern.operators import joins as J
from lectern.operators import ordered as O
from lectern.operators import segment as G
from lectern.plans import binding as B
from lectern.plans import sql as S
from lectern.plans.registry import query


@query("A1_corpus_counts", S.query("verses", """
    SELECT count(DISTINCT book) AS books, count(DISTINCT chapter_id) AS chapters, count(*) AS verses,
           sum(n_images)::BIGINT AS images FROM verses"""))
def _(s, d):
    return C.corpus_counts(B.chapters(s, d))


@query("A2_chapter_counts", S.query("books", """
    SELECT slug, b.title, b.position, b.chapter_count AS recorded, n AS counted, coalesce(n, b.chapter_count) AS chapter_count,
           n IS NOT NULL AND n <> b.chapter_count AS changed
    FROM books b LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) c ON c.source = b.slug"""))
def _(s, d):
    return C.chapter_counts(B.chapters(s, d), B.books(s, d))


@query("A3_translation_coverage", S.query("verses heads", """
    SELECT what, n, total, n || '/' || total || ' (' || CASE WHEN total = 0 THEN 0 ELSE 100 * n // total END || '%)' AS share FROM (
      SELECT 'zh_hant' AS what, count(*) FILTER (zh_hant <> '') AS n, count(*) AS total FROM verses
      UNION ALL SELECT 'zh_hans', count(*) FILTER (zh_hans <> ''), count(*) FROM verses
      UNION ALL SELECT 'ja', count(*) FILTER (ja <> ''), count(*) FROM verses
      UNION ALL SELECT 'preamble', count(*) FILTER (trim(pre_en) <> '' AND pre_hant <> ''), count(*) FILTER (trim(pre_en) <> '') FROM heads)"""))
def _(s, d):
    return C.translation_coverage(B.chapters(s, d))


@query("A7_max_images", S.query("verses", """
    SELECT n_images::BIGINT AS max_images, verse_id, n_images > 9 AS pileup FROM verses
    ORDER BY n_images DESC, book, chapter, ord LIMIT 1"""))
def _(s, d):
    return C.max_images(B.chapters(s, d))


@query("A8_merge_report", S.query("heads overlay", """
    SELECT outcome, count(*) AS n FROM (
      SELECT CASE WHEN o.book IS NULL THEN 'untouched' WHEN h.preamble_source = 'word-1882' THEN 'kept'
             WHEN h.preamble_source = 'sacred-texts' THEN 'already_filled' WHEN h.pre_en <> '' THEN 'kept'
             WHEN epigraph <> '' THEN 'filled' ELSE 'empty' END AS outcome
      FROM heads h LEFT JOIN overlay o ON h.book = o.book AND h.chapter = o.chapter
      UNION ALL SELECT 'absent' FROM overlay o ANTI JOIN heads h ON h.book = o.book AND h.chapter = o.chapter) GROUP BY 1"""))
def _(s, d):
    from lectern.operators import merge as M

    ch, ov = B.chapters(s, d), B.overlay(s, d)
    report = M.outcome_report(M.overlay_preamble(ch, ov))
    lost = M.absent_targets(ov, ch).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("absent").alias("outcome"), "n")
    return report.unionByName(lost)


@query("A9_book_source_text", S.query("verses heads", f"""
    SELECT h.book, h.chapter, CASE WHEN pre_en <> '' THEN pre_en || chr(10) ELSE '' END || body AS text
    FROM heads h JOIN (
      SELECT chapter_id, string_agg(en || CASE WHEN cap_en IS NOT NULL THEN chr(10) || cap_en ELSE '' END, chr(10) ORDER BY ord) AS body
      FROM verses GROUP BY 1) v USING (chapter_id)"""))
def _(s, d):
    return C.book_source_text(B.chapters(s, d))


@query("A12_first_seen", S.query("edges", """
    SELECT slug, arg_min(chapter_id, chapter) AS first_seen, min(chapter) AS first_chapter FROM edges GROUP BY 1"""))
def _(s, d):
    from lectern.operators.terms import term_forms, token_edges

    v = C.verses_of(B.chapters(s, d))
    e = token_edges(v, "en", ["chapter_id", "chapter", "ord"], term_forms(B.terms(s, d)))
    return e.groupBy("slug").agg(
        F.min_by("chapter_id", "chapter").alias("first_seen"), F.min("chapter").alias("first_chapter")
    )


@query("A13_distinct", S.query("v0", """
    SELECT en AS text, min(d * 1000000 + o) AS first_at, count(*) AS copies FROM v0 GROUP BY 1"""))
def _(s, d):
    v = C.verses_of(B.chapters(s, d)).select(F.col("en").alias("text"), (F.col("chapter") * 1_000_000 + F.col("ord")).alias("at"))
    # One aggregate: copies of a line merge before the shuffle.
    return v.groupBy("text").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("copies"))


@query("A14_derive_books", S.query("ranges", "SELECT slug, title, hi - lo + 1 AS chapter_count, lo // 100 AS position FROM ranges"))
def _(s, d):
    return C.derive_books(B.ranges(s, d))


# --- filters --------------------------------------------------------------------------


@query("F1_verse_range", S.query("verses", "SELECT chapter_id, ord, verse_id FROM verses WHERE verse_number BETWEEN 3 AND 7"))
def _(s, d):
    v = C.verses_of(B.chapters(s, d))
    return v.where(C.in_verse_range(F.col("verse_number"), 3, 7)).select("chapter_id", "ord", "verse_id")


@query("F3_captioned_images", S.query("verses", """
    SELECT verse_id || '#0' AS cap_idx, chapter_id, '/plates/image' || (d % 50) || '.jpg' AS src, cap_en AS en, cap_hant AS zh_hant
    FROM verses WHERE cap_en IS NOT NULL"""))
def _(s, d):
    return C.captions_of(B.chapters(s, d)).select("cap_idx", "chapter_id", "src", "en", "zh_hant")


@query("F4_drop_empty_chapters", S.query("verses", """
    SELECT chapter_id, count(*) AS n FROM verses WHERE trim(en) <> '' GROUP BY 1 HAVING count(*) > 2"""))
def _(s, d):
    # Blank lines do not count and chapters need a third verse here, so some do drop out.
    kept = F.filter("verses", lambda v: F.trim(v["en"]) != "")
    ch = B.chapters(s, d).withColumn("verses", F.when(F.size(kept) > 2, kept).otherwise(F.slice(kept, 1, 0)))
    return C.drop_empty_chapters(ch).select(F.col("id").alias("chapter_id"), F.size("verses").alias("n"))


@query("F7_untranslated", S.query("verses", """
    SELECT chapter_id, coalesce(bool_and(coalesce(zh_hant, '') = ''), true) AS no_hant, bool_and(coalesce(ja, '') = '') AS no_ja
    FROM verses GROUP BY 1"""))
def _(s, d):
    return B.chapters(s, d).select(
        F.col("id").alias("chapter_id"), C.untranslated("zh_hant").alias("no_hant"), C.untranslated("ja").alias("no_ja")
    )


# --- joins ----------------------------------------------------------------------------


@query("J1_range_assign", S.query("ranges", """
    SELECT d.doc_id AS n, r.slug, r.title, d.doc_id - r.lo + 1 AS ordinal
    FROM documents d LEFT JOIN ranges r ON d.doc_id BETWEEN r.lo AND r.hi"""))
def _(s, d):
    docs = B.table(s, d, "documents").select(F.col("doc_id").alias("n"))
    return J.assign_ranges(docs, "n", B.ranges(s, d))


@query("J2_overlay_join", S.query("heads overlay", """
    SELECT h.chapter_id, CASE WHEN o.book IS NULL OR h.preamble_source IS NOT NULL OR h.pre_en <> '' THEN h.pre_en
           WHEN epigraph <> '' THEN epigraph ELSE '' END AS en, o.book IS NOT NULL AS has_overlay
    FROM heads h LEFT JOIN overlay o ON h.book = o.book AND h.chapter = o.chapter"""))
def _(s, d):
    from lectern.operators import merge as M

    m = M.overlay_preamble(B.chapters(s, d), B.overlay(s, d))
    return m.select(F.col("id").alias("chapter_id"), "preamble.en", (F.col("outcome") != "untouched").alias("has_overlay"))


@query("J3_dimension_lookup", S.query("heads books", """
    SELECT h.chapter_id, coalesce(b.title, h.book) AS title FROM heads h LEFT JOIN books b ON b.slug = h.book"""))
def _(s, d):
    rows = B.chapters(s, d).select(F.col("id").alias("chapter_id"), "book")
    return J.lookup(rows, "book", B.books(s, d), F.col("book")).select("chapter_id", "title")


EXPECTED_VS_RECEIVED = """
    want AS (SELECT chapter_id, verse_id, count(*) AS n_expected FROM verses GROUP BY 1, 2),
    got AS (SELECT chapter_id, r_id AS verse_id, count(*) AS n_received FROM rverses GROUP BY 1, 2)"""


@query("J10_coverage_diff", S.query("verses rverses", f"""
    , {EXPECTED_VS_RECEIVED}
    SELECT chapter_id, verse_id, coalesce(n_expected, 0) AS n_expected, coalesce(n_received, 0) AS n_received,
           CASE WHEN coalesce(n_received, 0) = 0 THEN 'missing' WHEN coalesce(n_expected, 0) = 0 THEN 'extra'
                WHEN n_received > n_expected THEN 'duplicate' ELSE 'ok' END AS status
    FROM want FULL JOIN got USING (chapter_id, verse_id)"""))
def _(s, d):
    from lectern.operators.merge import results_by_position

    want = C.verses_of(B.chapters(s, d))
    return J.coverage_diff(want, results_by_position(B.results(s, d)), "chapter_id", "verse_id")


@query("J11_asof_hit", S.query("v0", """
    , a AS (SELECT d, book || '.' || d || '.' || o AS anchor, coalesce(sum(len(en) + 1) OVER (PARTITION BY d ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS location
                   FROM v0 QUALIFY o <> 1),
    h AS (SELECT doc_id AS d, unnest(range(0, len(text), 97)) AS location FROM documents)
    SELECT h.d, h.location, a.anchor FROM h ASOF JOIN a ON h.d = a.d AND h.location >= a.location"""))
def _(s, d):
    docs = B.table(s, d, "documents")
    lines = docs.select(
        F.col("doc_id").alias("d"), "source",
        F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.length(x) + 1)).alias("i", "n"),
    )
    # Start offset of a line: a running sum over the lengths of the lines, without the lines.
    before = W.partitionBy("d", "source").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    anchors = lines.withColumn("location", F.sum("n").over(before)).where("i > 0").select(
        "d", "location", F.concat_ws(".", "source", F.col("d").cast("string"), (F.col("i") + 1).cast("string")).alias("anchor"),
    )
    hits = docs.where(F.length("text") > 0).select(
        F.col("doc_id").alias("d"), F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(97))).alias("hit_no", "location")
    ).withColumn("location", F.col("location").cast("bigint"))
    return J.asof_anchors(hits, anchors, ["d"]).select("d", "location", "anchor")


@query("J13_membership", S.query("verses terms", """
    SELECT chapter_id, ord, tag FROM verses ANTI JOIN (SELECT slug FROM terms WHERE position % 2 = 0) ON tag = slug WHERE tag IS NOT NULL"""))
def _(s, d):
    tags = C.verses_of(B.chapters(s, d)).select("chapter_id", "ord", F.explode("glossary_terms").alias("tag"))
    # Half of the dictionary stays out, so that some tags really are unknown.
    return J.not_in(tags, B.terms(s, d).where("position % 2 = 0").select(F.col("slug").alias("tag")), "tag")


@query("J14_unknown_fill", S.query("delta stored", """
    SELECT kind, slug, pos FROM delta SEMI JOIN stored USING (slug) WHERE kind = 'fill'"""))
def _(s, d):
    delta = B.term_delta(s, d).where("kind = 'fill'")
    return J.known_only(delta, B.stored_terms(s, d), "slug").select("kind", "slug", "pos")


# --- windows and order ----------------------------------------------------------------


@query("W8_neighbours", """
    SELECT conv_id, turn, text, lag(text) OVER w AS previous, lead(text) OVER w AS following
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(s, d):
    t = B.dialogue(s, d).withColumn("_block", F.floor(F.col("turn") / 1024))
    return O.neighbours(t, ["conv_id"], "_block", [F.col("turn")], F.col("text")).select(
        "conv_id", "turn", "text", "previous", "following"
    )


@query("W8_verse_neighbours", S.query("verses", """
    SELECT chapter_id, ord, lag(en) OVER w AS previous, lead(en) OVER w AS following
    FROM verses WINDOW w AS (PARTITION BY chapter_id ORDER BY ord)"""))
def _(s, d):
    return C.verses_of(B.chapters(s, d), context=True).select("chapter_id", "ord", "previous", "following")


@query("W9_book_position", S.query("books", """
    SELECT source AS book, coalesce(b.title, upper(source[1]) || source[2:]) AS title,
           row_number() OVER (ORDER BY position NULLS LAST, source) AS position
    FROM (SELECT DISTINCT source FROM documents) LEFT JOIN books b ON slug = source"""))
def _(s, d):
    return C.number_books(B.chapters(s, d), B.books(s, d))


@query("W11_ordered_equals", S.query("verses rverses", """
    SELECT chapter_id, count(*) FILTER (w.verse_id IS DISTINCT FROM g.r_id) AS n_different
    FROM verses w
    FULL JOIN (SELECT chapter_id, ord, r_id FROM rverses) g USING (chapter_id, ord) GROUP BY 1"""))
def _(s, d):
    from lectern.operators.merge import results_by_position

    want = C.verses_of(B.chapters(s, d))
    return J.order_mismatch(want, results_by_position(B.results(s, d)), "chapter_id", "verse_id")


@query("O1_canonical_order", S.query("verses books", """
    , p AS (SELECT source AS book, row_number() OVER (ORDER BY position NULLS LAST, source) AS position
                 FROM (SELECT DISTINCT source FROM documents) LEFT JOIN books b ON slug = source)
    SELECT position, chapter, ord, verse_id FROM verses JOIN p USING (book) ORDER BY position, chapter, ord"""))
def _(s, d):
    ch = B.chapters(s, d)
    return C.canonical_order(C.verses_of(ch), C.number_books(ch, B.books(s, d))).select("position", "chapter", "ord", "verse_id")


@query("O7_sample_errors", S.query("verses", """
    SELECT lang, n, array_to_string(list_sort(ids)[1:5], ',') AS sample FROM (
      SELECT lang, count(*) AS n, list(verse_id) AS ids FROM verses WHERE coalesce(ja, '') = '' GROUP BY 1)"""))
def _(s, d):
    from lectern.operators.quality import sample_errors

    v = C.verses_of(B.chapters(s, d)).where("coalesce(ja, '') = ''")
    langs = B.table(s, d, "documents").select(F.col("doc_id").alias("chapter"), "lang")
    return sample_errors(v.join(langs, "chapter").select("lang", F.col("verse_id").alias("id"), F.lit("").alias("detail")), "lang", 5)


@query("S12_page_layout", S.query("heads", """
    SELECT chapter_id AS id, book, chapter, n AS n_chapters, n <> 1 AS has_index,
           CASE WHEN n = 1 THEN book ELSE book || '/' || CASE WHEN chapter < 10 THEN '0' ELSE '' END || chapter END AS path
    FROM (SELECT chapter_id, book || CASE WHEN d % 50 = 7 THEN '-' || d ELSE '' END AS book, chapter,
                 count(*) OVER (PARTITION BY book || CASE WHEN d % 50 = 7 THEN '-' || d ELSE '' END) AS n FROM heads)"""))
def _(s, d):
    # Every 50th document forms a book of its own, so both layouts occur.
    ch = B.chapters(s, d)
    own = F.when(F.col("chapter") % 50 == 7, F.concat("book", F.lit("-"), F.col("chapter").cast("string"))).otherwise(F.col("book"))
    return C.page_layout(ch.withColumn("book", own))


@query("T10_parallel_view", S.query("verses", """
    SELECT chapter_id, ord, verse_id, en AS source, coalesce(nullif(ja, ''), en, '') AS other, coalesce(ja, '') = '' AS fallback FROM verses"""))
def _(s, d):
    from lectern.operators.search import parallel_view

    return parallel_view(C.verses_of(B.chapters(s, d)), "ja")


@query("T10_long_form", S.query("verses", """
    SELECT lang, count(*) AS n, count(text) AS n_text FROM (
      SELECT 'en' AS lang, en AS text FROM verses UNION ALL SELECT 'zh_hant', zh_hant FROM verses
      UNION ALL SELECT 'zh_hans', zh_hans FROM verses UNION ALL SELECT 'ja', ja FROM verses) GROUP BY 1"""))
def _(s, d):
    from lectern.operators.search import long_form

    return long_form(C.verses_of(B.chapters(s, d))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("n_text"))


# --- set operations -------------------------------------------------------------------


@query("X2_missing_extra", S.query("verses rverses", """
    SELECT 'missing' AS side, chapter_id, verse_id FROM (SELECT chapter_id, verse_id FROM verses EXCEPT ALL SELECT chapter_id, r_id FROM rverses)
    UNION ALL SELECT 'extra', chapter_id, r_id FROM (SELECT chapter_id, r_id FROM rverses EXCEPT ALL SELECT chapter_id, verse_id FROM verses)"""))
def _(s, d):
    from lectern.operators.merge import results_by_position

    want = C.verses_of(B.chapters(s, d)).select("chapter_id", "verse_id")
    got = results_by_position(B.results(s, d)).select("chapter_id", "verse_id")
    return want.exceptAll(got).select(F.lit("missing").alias("side"), "*").unionByName(
        got.exceptAll(want).select(F.lit("extra").alias("side"), "*")
    )


@query("X3_union_sources", S.query("heads", """
    SELECT chapter_id, CASE WHEN book IN ('src1', 'src4') THEN 'section' ELSE 'standard' END AS origin FROM heads
    WHERE book NOT IN ('src1', 'src4') OR d % 3 = 0"""))
def _(s, d):
    rows = B.chapters(s, d).select(F.col("id").alias("chapter_id"), "book", "chapter")
    sections = rows.where("book in ('src1', 'src4') and chapter % 3 = 0").withColumn("origin", F.lit("section"))
    return G.union_sources(rows.withColumn("origin", F.lit("standard")), sections).select("chapter_id", "origin")


@query("X5_union_forms", S.query("stored delta", """
    SELECT DISTINCT slug, array_to_string(list_sort(list_distinct(list_concat(coalesce(source_forms, []), ['form ' || d.d, 'a form ' || c]))), '|') AS forms
    FROM stored JOIN delta d USING (slug)"""))
def _(s, d):
    from lectern.operators.merge import union_forms

    old = B.stored_terms(s, d).select("slug", F.col("source_forms").alias("o"))
    new = B.term_delta(s, d).select("slug", F.col("source_forms").alias("n"))
    return old.join(new, "slug").select("slug", F.array_join(union_forms(F.col("o"), F.col("n")), "|").alias("forms"))


@query("X6_set_equal", S.query("verses rverses", """
    SELECT v.chapter_id, v.ord, coalesce(v.tag, '') = coalesce(r.r_tag, '') AS same
    FROM verses v JOIN rverses r ON v.chapter_id = r.chapter_id AND v.ord = r.ord"""))
def _(s, d):
    from lectern.operators.merge import results_by_position
    from lectern.operators.terms import same_set

    a = C.verses_of(B.chapters(s, d)).select("chapter_id", "ord", F.col("glossary_terms").alias("a"))
    b = results_by_position(B.results(s, d)).select("chapter_id", "ord", F.col("glossary_terms").alias("b"))
    return a.join(b, ["chapter_id", "ord"]).select("chapter_id", "ord", same_set(F.col("a"), F.col("b")).alias("same"))


@query("X8_present_minus_ordered", S.query("books", """
    SELECT DISTINCT source AS book FROM documents ANTI JOIN books ON slug = source"""))
def _(s, d):
    known = B.books(s, d).select(F.col("slug").alias("book"))
    return J.not_in(B.chapters(s, d).select("book").distinct(), known, "book")


# --- fingerprints ---------------------------------------------------------------------


@query("FP1_verse_fp", S.query("verses", f"SELECT chapter_id, ord, verse_id, {S.sha16('en')} AS en_sha FROM verses"))
def _(s, d):
    return FP.verse_fingerprints(B.chapters(s, d))


CHAPTER_FP = f"""
    cfp AS (SELECT h.book, h.chapter, h.chapter_id,
      {S.sha16("vp || '|p:' || " + S.sha16('pre_en') + " || coalesce('|' || cp, '')")} AS src_sha
      FROM heads h JOIN (SELECT chapter_id, string_agg('v:' || verse_id || ':' || {S.sha16('en')}, '|' ORDER BY ord) AS vp,
           string_agg('c:' || verse_id || '#0:' || {S.sha16('cap_en')}, '|' ORDER BY ord) FILTER (cap_en IS NOT NULL) AS cp
           FROM verses GROUP BY 1) USING (chapter_id))"""


@query("FP2_chapter_fp", S.query("verses heads", f", {CHAPTER_FP} SELECT book, chapter, chapter_id, src_sha FROM cfp"))
def _(s, d):
    return FP.chapter_fingerprints(B.chapters(s, d))


# One digest tree over the hash digits of the chapter numbers, for books of any size.
BOOK_FP = f"""
    bk AS (SELECT book, 'chapter' || chr(1) || chapter AS k, {S.sha16('src_sha')} AS x FROM cfp),
    b4 AS (SELECT book, left({S.sha16('k')}, 4) AS b, {S.sha16("string_agg(k || '=' || x, chr(10) ORDER BY k, x)")} AS x FROM bk GROUP BY 1, 2),
    b2 AS (SELECT book, left(b, 2) AS b2, {S.sha16("string_agg(b || '=' || x, chr(10) ORDER BY b)")} AS x FROM b4 GROUP BY 1, 2),
    b0 AS (SELECT book, {S.sha16("string_agg(b2 || '=' || x, chr(10) ORDER BY b2)")} AS book_en_sha FROM b2 GROUP BY 1)"""


@query("FP3_book_fp", S.query("verses heads", f", {CHAPTER_FP}, {BOOK_FP} SELECT book, book_en_sha FROM b0"))
def _(s, d):
    return FP.book_fingerprints(FP.chapter_fingerprints(B.chapters(s, d)))


@query("FP4_manifest", S.query("verses heads", f"""
    SELECT chapter_id, 'verse' AS kind, verse_id AS key, ord, -1::BIGINT AS img_i, {S.sha16('en')} AS en_sha FROM verses
    UNION ALL SELECT chapter_id, 'caption', verse_id || '#0', ord, 0, {S.sha16('cap_en')} FROM verses WHERE cap_en IS NOT NULL
    UNION ALL SELECT chapter_id, 'preamble', chapter_id, 0, -1, {S.sha16('pre_en')} FROM heads"""))
def _(s, d):
    return FP.build_manifest(B.chapters(s, d)).drop("book", "chapter")


@query("FP5_snapshot_version", S.query("terms", f"""
    , r AS (SELECT 'all' AS book, 'terms' || chr(1) || slug AS k, {S.sha16("term || '/' || zh_hans || '/' || zh_hant")} AS x FROM terms
           UNION ALL SELECT 'all', 'source' || chr(1) || doc_id, {S.sha16('text')} FROM documents),
    l4 AS (SELECT book, left({S.sha16('k')}, 4) AS b, {S.sha16("string_agg(k || '=' || x, chr(10) ORDER BY k)")} AS x FROM r GROUP BY 1, 2),
    l2 AS (SELECT book, left(b, 2) AS b2, {S.sha16("string_agg(b || '=' || x, chr(10) ORDER BY b)")} AS x FROM l4 GROUP BY 1, 2)
    SELECT book, {S.sha16("string_agg(b2 || '=' || x, chr(10) ORDER BY b2)")} AS version FROM l2 GROUP BY 1"""))
def _(s, d):
    t = B.terms(s, d)
    parts = t.select(
        F.lit("all").alias("book"), F.lit("terms").alias("part"), "slug",
        F.concat_ws("/", "term", "translit.zh_hans", "translit.zh_hant").alias("payload"),
    ).unionByName(
        B.table(s, d, "documents").select(
            F.lit("all").alias("book"), F.lit("source").alias("part"), F.col("doc_id").cast("string").alias("slug"),
            F.col("text").alias("payload"),
        )
    )
    return FP.snapshot_versions(parts)


@query("FP6_drift_detect", S.query("verses heads", f""", {CHAPTER_FP}
    SELECT chapter_id FROM cfp JOIN documents ON doc_id = chapter WHERE doc_id % 7 = 0"""))
def _(s, d):
    ch = B.chapters(s, d)
    # The recorded side saw another preamble for every 7th chapter.
    edited = ch.withColumn("preamble", F.when(F.col("chapter") % 7 == 0, F.struct(
        F.lit("edited").alias("en"), *[F.col(f"preamble.{x}").alias(x) for x in X.LANGS]
    )).otherwise(F.col("preamble")))
    return FP.drifted(FP.chapter_fingerprints(edited), FP.chapter_fingerprints(ch)).select("chapter_id")


def bindings(s, d):
    """(snapshots, manifests) of all books; two snapshots are older than their source."""
    known = B.chapters(s, d).select("book").distinct()
    v = F.concat(F.lit("v-"), "book").alias("version")
    sha = F.concat(F.lit("sha-"), "book")
    snapshots = known.select("book", v, F.when(F.col("book").isin("src3", "src13"), "older").otherwise(sha).alias("book_en_sha"))
    return snapshots, known.select("book", sha.alias("book_en_sha"))


@query("FP7_stale_binding", S.query("heads", """
    SELECT chapter_id, book, d % 23 = 1 AS version_mismatch, book IN ('src3', 'src13') AS snapshot_stale,
           d % 31 = 2 AS binding_changed FROM heads WHERE d % 2 = 1"""))
def _(s, d):
    return FP.stale_bindings(B.results(s, d), *bindings(s, d))
