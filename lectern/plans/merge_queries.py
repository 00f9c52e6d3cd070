"""Upserts, conflict-checked commits and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.operators import fingerprint as FP
from lectern.operators import joins as J
from lectern.operators import merge as M
from lectern.operators import quality as K
from lectern.operators import validate as V
from lectern.plans import binding as B
from lectern.plans import sql as S
from lectern.plans.corpus_queries import CHAPTER_FP, bindings
from lectern.plans.registry import query
from lectern.session import cut_lineage


@query("U1_precedence_fill", S.query("heads overlay", """
    SELECT h.chapter_id,
      CASE WHEN o.book IS NULL OR h.preamble_source IS NOT NULL OR h.pre_en <> '' THEN h.pre_en
           WHEN epigraph <> '' THEN epigraph ELSE '' END AS en,
      CASE WHEN o.book IS NULL OR h.preamble_source IS NOT NULL THEN h.preamble_source WHEN h.pre_en <> '' THEN 'word-1882'
           WHEN epigraph <> '' THEN 'sacred-texts' END AS tag,
      o.book IS NOT NULL AND h.preamble_source IS NULL
        AND (h.pre_en <> '' OR epigraph <> '' OR h.pre_en IS NULL) AS changed, h.pre_hant AS zh_hant
    FROM heads h LEFT JOIN overlay o ON h.book = o.book AND h.chapter = o.chapter"""))
def _(s, d):
    m = M.overlay_preamble(B.chapters(s, d), B.overlay(s, d))
    return m.select(
        F.col("id").alias("chapter_id"), "preamble.en", F.col("preamble_source").alias("tag"),
        F.coalesce("changed", F.lit(False)).alias("changed"), "preamble.zh_hant",
    )


@query("U1_idempotent", "SELECT 0::BIGINT AS changed_again, count(*) AS chapters FROM documents")
def _(s, d):
    overlay = B.overlay(s, d)
    once = M.overlay_preamble(B.chapters(s, d), overlay).drop("outcome", "changed")
    again = M.overlay_preamble(once, overlay)
    return again.agg(F.count_if(F.col("changed")).alias("changed_again"), F.count(F.lit(1)).alias("chapters"))


PAIRS = """
    p AS (SELECT v.chapter_id, v.ord, v.zh_hant AS old, r.r_hant AS new FROM verses v LEFT JOIN rverses r
          ON v.chapter_id = r.chapter_id AND v.ord = r.ord)"""


def pairs(s, d):
    old = C.verses_of(B.chapters(s, d)).select("chapter_id", "ord", F.col("zh_hant").alias("old"))
    new = M.results_by_position(B.results(s, d)).select("chapter_id", "ord", F.col("zh_hant").alias("new"))
    return old.join(new, ["chapter_id", "ord"], "left")


@query("U2_fill_nulls", S.query("verses rverses", f", {PAIRS} SELECT chapter_id, ord, coalesce(old, new) AS text, old IS NULL AND new IS NOT NULL AS filled FROM p"))
def _(s, d):
    old, new = F.col("old"), F.col("new")
    return pairs(s, d).select(
        "chapter_id", "ord", M.fill_nulls(old, new).alias("text"), (old.isNull() & new.isNotNull()).alias("filled")
    )


@query("U3_fill_blank", S.query("verses rverses", f", {PAIRS} SELECT chapter_id, ord, coalesce(nullif(old, ''), nullif(new, ''), old) AS text FROM p"))
def _(s, d):
    return pairs(s, d).select("chapter_id", "ord", M.fill_blank(F.col("old"), F.col("new")).alias("text"))


@query("U4_overwrite", S.query("verses rverses", """
    SELECT v.chapter_id, v.ord, coalesce(r.r_hant, v.zh_hant) AS zh_hant, coalesce(r.r_ja, v.ja) AS ja
    FROM verses v LEFT JOIN (SELECT chapter_id, r_id, arg_max(r_hant, ord) AS r_hant, arg_max(r_ja, ord) AS r_ja FROM rverses GROUP BY 1, 2) r
      ON v.chapter_id = r.chapter_id AND v.verse_id = r.r_id"""))
def _(s, d):
    out = M.overwrite_verses(C.verses_of(B.chapters(s, d)), M.results_by_position(B.results(s, d)))
    return out.select("chapter_id", "ord", "zh_hant", "ja")


def failures(s, d):
    """Chapters whose result breaks any rule."""
    return V.refused(B.chapters(s, d), B.results(s, d), B.terms(s, d), *bindings(s, d))


# A chapter is refused for every planted defect: verses missing, foreign, out of place or
# blank; kana; preamble; captions; tags; unknown terms; locks; bindings; or when its source
# changed since the manifest (every 7th document here).  Even documents have no result.
REFUSED = """
    refused AS (SELECT DISTINCT d FROM (
        SELECT w.d FROM (SELECT d, ord, verse_id FROM verses WHERE d % 2 = 1) w
        LEFT JOIN rverses r ON w.d = r.d AND w.ord = r.ord WHERE w.verse_id IS DISTINCT FROM r.r_id
        UNION ALL SELECT d FROM rverses WHERE trim(r_hant) = '' OR trim(r_hans) = '' OR trim(r_ja) = ''
        UNION ALL SELECT d FROM rverses WHERE regexp_matches(r_hant, '[぀-ヿ]') OR regexp_matches(r_hans, '[぀-ヿ]')
        UNION ALL SELECT d FROM heads WHERE d % 4 = 1 AND pre_en <> ''
        UNION ALL SELECT v.d FROM verses v LEFT JOIN rcaps c ON c.cap_idx = v.verse_id || '#0' WHERE v.cap_en IS NOT NULL AND c.cap_idx IS NULL
        UNION ALL SELECT c.d FROM rcaps c LEFT JOIN verses v ON v.cap_en IS NOT NULL AND c.cap_idx = v.verse_id || '#0' WHERE v.d IS NULL
        UNION ALL SELECT d FROM rcaps WHERE c_ja IS NULL
        UNION ALL SELECT d FROM rverses WHERE r_tag IS NOT NULL AND r_tag NOT IN (SELECT slug FROM terms) AND r_tag NOT IN (SELECT lower(term) FROM terms)
        UNION ALL SELECT e.chapter FROM edges e JOIN rverses r ON r.d = e.chapter AND r.ord = e.ord JOIN terms t ON t.slug = e.slug
          WHERE (t.zh_hant <> '' AND NOT contains(r.r_hant, t.zh_hant)) OR (t.zh_hans <> '' AND NOT contains(r.r_hans, t.zh_hans))
             OR (t.ja <> '' AND NOT contains(r.r_ja, t.ja))
        UNION ALL SELECT d FROM heads WHERE d % 29 = 1 OR d % 23 = 1 OR d % 31 = 2 OR book IN ('src3', 'src13')
        UNION ALL SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 2 = 0))"""


def merged(s, d):
    ch = B.chapters(s, d)
    # Small beside the text, and read twice.
    live = cut_lineage(FP.chapter_fingerprints(ch))
    recorded = live.withColumn(
        "src_sha", F.when(F.col("chapter") % 7 == 0, "stale").otherwise(F.col("src_sha"))
    )
    return M.merge_chapters(ch, B.results(s, d), recorded, failures(s, d), live)


@query("U5_merge_chapter", S.query("edges rverses rcaps heads terms", f""", {REFUSED}
    SELECT v.chapter_id, v.ord, f.d IS NULL AS merged,
      CASE WHEN f.d IS NULL THEN coalesce(nullif(v.zh_hant, ''), nullif(r.r_hant, ''), v.zh_hant) ELSE v.zh_hant END AS zh_hant,
      CASE WHEN f.d IS NULL THEN coalesce(nullif(v.ja, ''), nullif(r.r_ja, ''), v.ja) ELSE v.ja END AS ja,
      coalesce(v.tag, CASE WHEN f.d IS NULL THEN r.r_tag END, '') AS tags
    FROM verses v LEFT JOIN refused f ON f.d = v.d LEFT JOIN rverses r ON r.d = v.d AND r.ord = v.ord"""))
def _(s, d):
    m = merged(s, d).withColumn("_m", F.col("merged"))
    rows = m.select(F.col("id").alias("chapter_id"), "merged", F.posexplode("verses").alias("i", "v"))
    return rows.select(
        "chapter_id", (F.col("i") + 1).alias("ord"), "merged", "v.zh_hant", "v.ja",
        F.array_join(F.coalesce("v.glossary_terms", F.array().cast("array<string>")), ",").alias("tags"),
    )


@query("U5_merge_report", S.query("edges rverses rcaps heads terms", f""", {REFUSED},
    n AS (SELECT v.d, count(*) AS verses_merged,
               sum((v.zh_hant <> '')::INT + 0)::BIGINT AS a, sum((v.zh_hans <> '' AND r.r_hans <> '')::INT)::BIGINT AS b,
               sum((v.ja <> '')::INT)::BIGINT AS c
          FROM verses v JOIN rverses r ON r.d = v.d AND r.ord = v.ord WHERE v.d NOT IN (SELECT d FROM refused) GROUP BY 1),
    k AS (SELECT v.d, count(*) AS captions FROM verses v JOIN rcaps c ON c.cap_idx = v.verse_id || '#0'
          WHERE v.cap_en IS NOT NULL GROUP BY 1)
    SELECT count(*) AS chapters, sum(verses_merged)::BIGINT AS verses, sum(a + coalesce(b, 0) + coalesce(c, 0))::BIGINT AS skipped_nonnull,
           sum(coalesce(captions, 0))::BIGINT AS captions FROM n LEFT JOIN k USING (d)"""))
def _(s, d):
    return merged(s, d).where("merged").agg(
        F.count(F.lit(1)).alias("chapters"), F.sum("verses_merged").alias("verses"),
        F.sum("skipped_nonnull").alias("skipped_nonnull"), F.sum("captions_merged").alias("captions"),
    )


# First coin decides a new slug; every further row fills nulls only.
USED = """
    used AS (SELECT x.*, row_number() OVER (PARTITION BY x.slug ORDER BY CASE WHEN kind = 'coin' THEN 1 ELSE 0 END, pos) AS n
             FROM delta x LEFT JOIN stored t USING (slug) WHERE kind = 'coin' OR t.slug IS NOT NULL),
    folded AS (SELECT slug, arg_min(hant, n) FILTER (hant IS NOT NULL) AS hant, arg_min(hans, n) FILTER (hans IS NOT NULL) AS hans,
                      arg_min(ja, n) FILTER (ja IS NOT NULL) AS ja, arg_min(note_hant, n) FILTER (note_hant IS NOT NULL) AS note_hant,
                      arg_min(term, n) AS term, arg_min(chapter_id, n) AS scope, bool_or(kind = 'fill') AS any_fill,
                      bool_or(TRUE) AS touched FROM used GROUP BY 1)"""


@query("U6_coin_or_fill", S.query("stored delta", f""", {USED}
    SELECT slug, coalesce(t.term, f.term) AS term, coalesce(t.hant, f.hant) AS zh_hant, coalesce(t.hans, f.hans) AS zh_hans,
           coalesce(t.ja, f.ja) AS ja, f.note_hant AS note_hant,
           CASE WHEN t.slug IS NULL THEN 'coined' WHEN f.touched THEN 'filled' ELSE 'unchanged' END AS outcome,
           CASE WHEN t.slug IS NULL THEN TRUE
                WHEN any_fill AND coalesce(t.hant, f.hant) <> '' AND coalesce(t.hans, f.hans) <> '' AND coalesce(t.ja, f.ja) <> '' THEN TRUE
                ELSE FALSE END AS locked,
           CASE WHEN t.slug IS NULL THEN scope WHEN any_fill THEN coalesce(t.first_seen, scope) ELSE t.first_seen END AS first_seen
    FROM stored t FULL JOIN folded f USING (slug)"""))
def _(s, d):
    out = M.coin_or_fill(B.stored_terms(s, d), B.term_delta(s, d))
    return out.select(
        "slug", "term", "translit.*", F.col("editor_note.zh_hant").alias("note_hant"), "outcome", "locked", "first_seen"
    )


@query("U7_append_new", S.query("stored delta", """
    SELECT slug AS en, hant AS zh_hant FROM stored UNION ALL
    SELECT slug, arg_min(hant, pos) FROM delta ANTI JOIN stored USING (slug) GROUP BY 1"""))
def _(s, d):
    base = B.stored_terms(s, d).select(F.col("slug").alias("en"), "translit.zh_hant")
    extra = B.term_delta(s, d).select(F.col("slug").alias("en"), "translit.zh_hant", "pos")
    return M.append_new(base, extra, "en", F.col("pos"))


# Leaf by leaf: what a fill meets (the stored value, else what an earlier fill set).
REPORT = """
    f AS (SELECT x.slug, x.pos, t.hant AS o1, x.hant AS n1, t.hans AS o2, x.hans AS n2, t.ja AS o3, x.ja AS n3
          FROM delta x JOIN stored t USING (slug) WHERE kind = 'fill'),
    leaf AS (SELECT slug, pos, 'translit.zh_hant' AS field, o1 AS o, n1 AS n FROM f UNION ALL SELECT slug, pos, 'translit.zh_hans', o2, n2 FROM f
             UNION ALL SELECT slug, pos, 'translit.ja', o3, n3 FROM f),
    met AS (SELECT *, coalesce(nullif(o, ''), first_value(n IGNORE NULLS) OVER (PARTITION BY slug, field ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS cur FROM leaf),
    rep AS (
      SELECT 'kept_existing' AS action, slug AS key, field FROM met WHERE n IS NOT NULL AND cur <> n
      UNION ALL SELECT 'filled', slug, '' FROM f
      UNION ALL SELECT 'coined', slug, '' FROM (SELECT DISTINCT slug FROM delta WHERE kind = 'coin') ANTI JOIN stored USING (slug)
      UNION ALL SELECT 'conflict', slug, field FROM (
        SELECT x.slug, unnest(['translit.zh_hant', 'translit.zh_hans', 'translit.ja']) AS field, unnest([x.hant, x.hans, x.ja]) AS n,
               unnest([coalesce(t.hant, CASE WHEN t.slug IS NULL AND x.pos > y.pos THEN y.hant END),
                       coalesce(t.hans, CASE WHEN t.slug IS NULL AND x.pos > y.pos THEN y.hans END),
                       coalesce(t.ja, CASE WHEN t.slug IS NULL AND x.pos > y.pos THEN y.ja END)]) AS cur
        FROM delta x LEFT JOIN stored t USING (slug)
        JOIN (SELECT slug, min(pos) AS pos, arg_min(hant, pos) AS hant, arg_min(hans, pos) FILTER (hans IS NOT NULL) AS hans,
                     any_value(ja) FILTER (c = 1) AS ja FROM delta WHERE kind = 'coin' GROUP BY 1) y ON y.slug = x.slug
        WHERE x.kind = 'coin') WHERE n <> '' AND cur <> '' AND n <> cur)"""


def lexicons(s, d):
    """(stored, new): phrases of two thirds of the documents, and a change set that repeats, fills and adds some."""
    docs = B.table(s, d, "documents")
    k = F.col("doc_id")
    en = F.concat(F.lit("phrase "), k.cast("string"))
    mark = lambda sign: F.concat(F.lit(sign), k.cast("string"))
    stored = docs.where("doc_id % 3 <> 0").select(
        en.alias("en"), mark("句").alias("zh_hant"), F.when(k % 2 == 0, mark("句")).alias("zh_hans"), F.lit("").alias("ja"))
    new = docs.where("doc_id % 4 = 0").select(
        en.alias("en"), mark("句").alias("zh_hant"), mark("语").alias("zh_hans"), mark("ク").alias("ja"), k.alias("pos"))
    return stored, new


LEXICON = """
    lex AS (SELECT 'phrase ' || doc_id AS en, '句' || doc_id AS hant, CASE WHEN doc_id % 2 = 0 THEN '句' || doc_id END AS hans, '' AS ja
            FROM documents WHERE doc_id % 3 <> 0),
    newlex AS (SELECT 'phrase ' || doc_id AS en, '句' || doc_id AS hant, '语' || doc_id AS hans, 'ク' || doc_id AS ja FROM documents WHERE doc_id % 4 = 0),
    lexrep AS (
      SELECT 'conflict' AS action, en AS key, 'lexicon.zh_hans' AS field FROM newlex JOIN lex USING (en) WHERE lex.hans <> '' AND lex.hans <> newlex.hans
      UNION ALL SELECT 'lexicon', en, '' FROM newlex ANTI JOIN lex USING (en))"""


@query("U8_commit_report", S.query("stored delta", f""", {REPORT}, {LEXICON} SELECT action, key, field FROM rep UNION ALL SELECT * FROM lexrep"""))
def _(s, d):
    return M.commit_report(B.stored_terms(s, d), B.term_delta(s, d), *lexicons(s, d))


@query("U8_commit_refused", S.query("stored", "SELECT slug, hant AS zh_hant, locked FROM (SELECT *, FALSE AS locked FROM stored)"))
def _(s, d):
    # The change set holds conflicts, so both dictionaries stay as they were.
    lexicon = B.stored_terms(s, d).select(F.col("slug").alias("en"), "translit.*")
    new = B.term_delta(s, d).select(F.col("slug").alias("en"), "translit.*", "pos")
    terms, _, _ = M.commit(B.stored_terms(s, d), B.term_delta(s, d), lexicon, new)
    return terms.select("slug", "translit.zh_hant", "locked")


@query("U8_commit_accepted", S.query("stored delta", """
    SELECT slug, coalesce(nullif(t.hant, ''), x.hant, t.hant) AS zh_hant, coalesce(t.ja, x2.ja) AS ja,
           x.slug IS NOT NULL AND coalesce(nullif(t.hant, ''), x.hant) <> '' AND coalesce(t.hans, x.hans) <> '' AND coalesce(t.ja, x2.ja) <> '' IS TRUE AS locked
    FROM stored t LEFT JOIN (SELECT * FROM delta WHERE kind = 'fill' AND c = 1) x USING (slug)
    LEFT JOIN (SELECT slug, ja FROM delta WHERE kind = 'fill' AND c = 2) x2 USING (slug)"""))
def _(s, d):
    # Fills alone never conflict: what exists is kept and reported.  Nor do phrases that are new.
    stored, new = lexicons(s, d)
    fills = B.term_delta(s, d).where("kind = 'fill'")
    terms, _, _ = M.commit(B.stored_terms(s, d), fills, stored, new.join(stored, "en", "left_anti"))
    return terms.select("slug", "translit.zh_hant", "translit.ja", F.coalesce("locked", F.lit(False)).alias("locked"))


@query("U8_commit_lexicon", S.query("", f"""
    WITH {LEXICON} SELECT en, hant AS zh_hant, hans AS zh_hans, ja FROM lex
    UNION ALL SELECT en, hant, hans, ja FROM newlex ANTI JOIN lex USING (en)"""))
def _(s, d):
    # The accepted lexicon: stored phrases as they were, and the new ones of the change set.
    stored, new = lexicons(s, d)
    fills = B.term_delta(s, d).where("kind = 'fill'")
    return M.commit(B.stored_terms(s, d), fills, stored, new.join(stored, "en", "left_anti"))[1]


@query("U9_inject_images", S.query("verses", """
    SELECT chapter_id, ord, n_images::BIGINT + CASE WHEN verse_number = 10 AND ord = first_ord AND d % 2 = 0
        THEN CASE WHEN n_images > 0 THEN 1 ELSE 2 END ELSE 0 END AS n_images
    FROM (SELECT *, min(CASE WHEN verse_number = 10 THEN ord END) OVER (PARTITION BY chapter_id) AS first_ord FROM verses)"""))
def _(s, d):
    # Two pictures for verse 10 of even documents; one of them is there already on line 10.
    docs = B.table(s, d, "documents").where("doc_id % 2 = 0")
    old = F.concat(F.lit("/plates/image"), (F.col("doc_id") % 50).cast("string"), F.lit(".jpg"))
    new = docs.select(
        F.col("source").alias("book"), F.col("doc_id").alias("chapter"), F.lit(10).alias("verse_number"),
        F.posexplode(F.array(old, F.lit("/plates/new.jpg"))).alias("pos", "src"),
        F.lit("1").alias("edition"), F.lit(None).cast(B.caption_type()).alias("caption"),
    )
    out = M.inject_images(C.verses_of(B.chapters(s, d)), new)
    return out.select("chapter_id", "ord", F.coalesce(F.size("images"), F.lit(0)).alias("n_images"))


@query("U10_in_memory_apply", S.query("stored delta", """
    SELECT slug, coalesce(nullif(t.hant, ''), x.hant, t.hant) AS zh_hant, coalesce(t.ja, x2.ja) AS ja,
           array_to_string(CASE WHEN x.slug IS NULL THEN source_forms ELSE list_sort(list_distinct(list_concat(coalesce(source_forms, []),
              ['form ' || x.d, 'a form 1'], CASE WHEN x2.slug IS NOT NULL THEN ['a form 2'] ELSE [] END))) END, '|') AS forms
    FROM stored t LEFT JOIN (SELECT * FROM delta WHERE kind = 'fill' AND c = 1) x USING (slug)
    LEFT JOIN (SELECT slug, ja FROM delta WHERE kind = 'fill' AND c = 2) x2 USING (slug)
    UNION ALL SELECT slug, hant, ja, 'form ' || d || '|a form 1' FROM delta ANTI JOIN stored USING (slug) WHERE kind = 'coin' AND c = 1"""))
def _(s, d):
    out = M.apply_in_memory(B.stored_terms(s, d), B.term_delta(s, d))
    return out.select("slug", "translit.zh_hant", "translit.ja", F.array_join("source_forms", "|").alias("forms"))


@query("U11_repair_leaks", S.query("verses terms", """
    SELECT v.chapter_id, v.ord, CASE WHEN t.ja IS NOT NULL AND v.ja <> '' THEN replace(replace(v.ja, t.zh_hant, t.ja), t.zh_hans, t.ja) ELSE v.ja END AS ja
    FROM verses v LEFT JOIN (SELECT * FROM terms x WHERE position = (SELECT min(position) FROM terms y WHERE x.term = y.term)) t ON t.slug = v.tag"""))
def _(s, d):
    terms = B.terms(s, d)
    first = terms.groupBy("term").agg(F.min_by("slug", "position").alias("slug"))
    names = terms.join(first.select("slug"), "slug").select("slug", "term", "translit")
    v = C.verses_of(B.chapters(s, d))
    tagged = v.select("chapter_id", "ord", F.explode("glossary_terms").alias("slug")).join(names, "slug")
    tags = tagged.select("chapter_id", "ord", F.array("term").alias("tags"))
    rows = v.join(tags, ["chapter_id", "ord"], "left").withColumn(
        "glossary_terms", F.coalesce("tags", F.array().cast("array<string>"))
    )
    return M.repair_leaks(rows, names).select("chapter_id", "ord", "ja")


@query("J9_pair_with_source", S.query("verses rverses", """
    SELECT r.chapter_id, r.ord, r.r_id AS verse_id, v.en FROM rverses r
    LEFT JOIN (SELECT verse_id, arg_max(en, ord) AS en FROM verses GROUP BY 1) v ON v.verse_id = r.r_id"""))
def _(s, d):
    got = M.results_by_position(B.results(s, d))
    return M.pair_with_source(got, C.verses_of(B.chapters(s, d))).select("chapter_id", "ord", "verse_id", "en")


@query("J12_caption_match", S.query("verses", """
    SELECT verse_id, ord, CASE WHEN d % 3 <> 1 OR n = 1 THEN coalesce(cap_hant, '新') ELSE cap_hant END AS zh_hant,
           d % 3 <> 1 OR n = 1 AS matched
    FROM (SELECT *, count(*) OVER (PARTITION BY chapter_id, verse_id) AS n FROM verses WHERE cap_en IS NOT NULL)"""))
def _(s, d):
    caps = C.captions_of(B.chapters(s, d))
    # Every third chapter answers without repeating the English caption.
    got = caps.select(
        "verse_id", F.when(F.col("chapter") % 3 != 1, F.col("en")).alias("en"), F.lit("新").alias("zh_hant"),
        F.lit("新").alias("zh_hans"), F.lit("新").alias("ja"), F.col("ord").alias("pos"),
    )
    return M.match_captions(caps, got).select("verse_id", "ord", "zh_hant", "matched")


@query("S9_write_if_changed", """
    SELECT doc_id AS chapter, 'changed' AS change FROM documents WHERE doc_id % 7 = 0 AND doc_id % 10 <> 9
    UNION ALL SELECT doc_id, 'removed' FROM documents WHERE doc_id % 10 = 9""")
def _(s, d):
    old = B.chapters(s, d).select("chapter", "preamble", "verses")
    new = old.where("chapter % 10 <> 9").withColumn("preamble", F.when(F.col("chapter") % 7 == 0, F.struct(
        F.lit("edited").alias("en"), *[F.col(f"preamble.{x}").alias(x) for x in X.LANGS]
    )).otherwise(F.col("preamble")))
    return M.differing(old, new, ["chapter"])
