"""Data-quality rules over derived documents with planted defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.operators import merge as M
from lectern.operators import quality as K
from lectern.operators.terms import term_forms
from lectern.plans import binding as B
from lectern.plans import sql as S
from lectern.plans.registry import query

BARE = {"ignoreNullFields": "false"}


def verses(s, d):
    return C.verses_of(B.chapters(s, d))


def received(s, d):
    return M.results_by_position(B.results(s, d))


@query("Q1_books", """
    SELECT 'books.required' AS rule, doc_id::VARCHAR AS path, source AS id, 'missing title' AS detail FROM documents WHERE doc_id % 6 = 1
    UNION ALL SELECT 'books.chapter_count', doc_id::VARCHAR, source, 'not an integer' FROM documents WHERE doc_id % 10 = 3""")
def _(s, d):
    k = F.col("doc_id")
    docs = B.table(s, d, "documents")
    full = F.struct(F.col("source").alias("slug"), F.col("source").alias("title"), F.col("n_chars").alias("chapter_count"))
    lame = F.struct(F.col("source").alias("slug"), F.col("n_chars").alias("chapter_count"))
    text = F.struct(F.col("source").alias("slug"), F.col("source").alias("title"), F.lit("12").alias("chapter_count"))
    raw = F.when((k % 6 == 1) & (k % 10 == 3), F.to_json(F.struct(F.col("source").alias("slug"), F.lit("12").alias("chapter_count")))).when(
        k % 6 == 1, F.to_json(lame)).when(k % 10 == 3, F.to_json(text)).otherwise(F.to_json(full))
    return K.check_books(docs.select(k.alias("path"), raw.alias("raw")))


@query("Q2_plates", """
    SELECT 'plates.required' AS rule, doc_id::VARCHAR AS path, doc_id::VARCHAR AS id, 'missing title' AS detail FROM documents WHERE doc_id % 9 = 4
    UNION ALL SELECT 'plates.count', 'plates', '', 'expected 97, got ' || count(*) FROM documents HAVING count(*) <> 97""")
def _(s, d):
    k = F.col("doc_id")
    raw = F.when(k % 9 == 4, F.to_json(F.struct(k.alias("id")))).otherwise(F.to_json(F.struct(k.alias("id"), F.col("source").alias("title"))))
    return K.check_plates(B.table(s, d, "documents").select(k.alias("path"), raw.alias("raw")))


@query("Q3_terms", S.query("stored", """
    , st AS (SELECT d, CASE WHEN d % 20 = 1 THEN 's' || (d + 1) ELSE slug END AS sid FROM stored)
    SELECT 'terms.required' AS rule, sid AS path, sid AS id, 'missing appears_in,cross_refs' AS detail FROM st
    UNION ALL SELECT 'terms.category', sid, sid, 'bad category verb' FROM st WHERE d % 5 = 1
    UNION ALL SELECT 'terms.category', sid, sid, 'bad category null' FROM st WHERE d % 5 = 2
    UNION ALL SELECT 'terms.duplicate', 'terms', sid, 'repeated 1' FROM st GROUP BY sid HAVING count(*) > 1"""))
def _(s, d):
    t = B.stored_terms(s, d)
    k = F.col("position")
    t = t.withColumn("slug", F.when(k % 20 == 1, F.concat(F.lit("s"), (k + 1).cast("string"))).otherwise(F.col("slug")))
    cat = F.when(k % 5 == 1, "verb").when(k % 5 != 2, "name").alias("category")
    raw = F.to_json(F.struct(
        "term", "slug", cat, "translit", "source_def", "source_def_literal", "editor_note", "locked", "first_seen"
    ), BARE)
    return K.check_terms(t.select(F.col("slug").alias("path"), raw.alias("raw")))


@query("Q4_lexicon", """
    SELECT 'lexicon.required' AS rule, doc_id::VARCHAR AS path, 'w' || doc_id AS id, 'missing ja' AS detail FROM documents WHERE doc_id % 4 = 1
    UNION ALL SELECT 'lexicon.category', doc_id::VARCHAR, 'w' || doc_id, 'bad category noun' FROM documents WHERE doc_id % 7 = 1""")
def _(s, d):
    k = F.col("doc_id")
    en = F.concat(F.lit("w"), k.cast("string")).alias("en")
    cat = F.when(k % 7 == 1, "noun").when(k % 2 == 0, "verb").otherwise("phrase").alias("category")
    zh = [F.lit("字").alias("zh_hant"), F.lit("字").alias("zh_hans")]
    raw = F.when(k % 4 == 1, F.to_json(F.struct(en, cat, *zh))).otherwise(
        F.to_json(F.struct(en, cat, *zh, F.lit(None).cast("string").alias("ja")), BARE))
    return K.check_lexicon(B.table(s, d, "documents").select(k.alias("path"), raw.alias("raw")))


def chapter_raw(s, d):
    """Chapter JSON texts; the remainder of doc_id by 12 picks the defect."""
    ch = B.chapters(s, d)
    k = F.col("chapter")
    slim = F.transform("verses", lambda v: F.struct(v["id"].alias("id"), v["en"].alias("en")))

    def doc(**change):
        fields = {
            "id": F.col("id"), "book": F.col("book"), "chapter": k, "title": F.col("title"),
            "preamble": F.col("preamble"), "preamble_source": F.col("preamble_source"), "verses": slim,
        }
        fields.update(change)
        return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items() if c is not None]), BARE)

    raw = (
        F.when(k % 12 == 0, F.concat(doc(), F.lit("}")))
        .when(k % 12 == 1, doc(title=None))
        .when(k % 12 == 2, doc(id=F.upper("id")))
        .when(k % 12 == 3, doc(verses=F.lit("none")))
        .when(k % 12 == 4, doc(preamble=F.lit("old text")))
        .when(k % 12 == 5, doc(preamble=F.struct(F.lit("x").alias("en"), F.lit("x").alias("ja"))))
        .when(k % 12 == 6, doc(preamble_source=None))
        .when(k % 12 == 7, doc(preamble_source=F.lit("elsewhere")))
        .when(k % 12 == 8, doc(preamble=F.lit(None).cast("string")))
        .otherwise(doc())
    )
    return ch.select(F.col("id").alias("path"), raw.alias("raw"))


@query("Q5_Q6_chapters", S.query("heads", """
    SELECT * FROM (SELECT CASE d % 12 WHEN 0 THEN 'chapter.json' WHEN 1 THEN 'chapter.required' WHEN 2 THEN 'chapter.id' WHEN 3 THEN 'chapter.verses'
        WHEN 4 THEN 'preamble.shape' WHEN 5 THEN 'preamble.keys' WHEN 6 THEN 'preamble.source' WHEN 7 THEN 'preamble.source' END AS rule,
      chapter_id AS path, CASE d % 12 WHEN 0 THEN '' WHEN 2 THEN upper(chapter_id) ELSE chapter_id END AS id,
      CASE d % 12 WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'missing title' WHEN 2 THEN 'bad chapter id' WHEN 3 THEN 'verses must be an array'
        WHEN 4 THEN 'preamble must be an object' WHEN 5 THEN 'missing zh_hant,zh_hans' WHEN 6 THEN 'missing preamble_source'
        WHEN 7 THEN 'bad preamble_source elsewhere' END AS detail FROM heads) WHERE rule IS NOT NULL"""))
def _(s, d):
    return K.check_chapters(chapter_raw(s, d))


@query("X1_missing_fields", S.query("heads", """
    SELECT chapter_id AS path, CASE d % 12 WHEN 1 THEN 'title' WHEN 6 THEN 'preamble_source' ELSE '' END AS missing FROM heads WHERE d % 12 <> 0"""))
def _(s, d):
    rows = chapter_raw(s, d).where(K.is_json_object(F.col("raw")))
    absent = K.missing_fields(F.col("raw"), [*K.CHAPTER_FIELDS, "preamble_source"])
    return rows.select("path", F.array_join(absent, ",").alias("missing"))


@query("X7_subset", S.query("heads", "SELECT chapter_id AS path, d % 12 NOT IN (4, 5, 8) AS complete FROM heads WHERE d % 12 <> 0"))
def _(s, d):
    rows = chapter_raw(s, d).where(K.is_json_object(F.col("raw")))
    absent = K.missing_fields(F.get_json_object("raw", "$.preamble"), K.I18N_FIELDS)
    return rows.select("path", (F.size(absent) == 0).alias("complete"))


@query("Q7_verses", S.query("verses", """
    SELECT 'verse.id' AS rule, chapter_id AS path, CASE WHEN d % 8 = 1 THEN upper(verse_id) ELSE verse_id END AS id, 'bad verse id' AS detail
    FROM verses WHERE d % 8 = 1
    UNION ALL SELECT 'verse.en', chapter_id, CASE WHEN d % 8 = 1 THEN upper(verse_id) ELSE verse_id END, 'no English' FROM verses WHERE coalesce(CASE WHEN o % 9 = 0 THEN NULL WHEN o % 9 = 1 AND d % 3 = 0 THEN '' ELSE en END, '') = ''"""))
def _(s, d):
    o, k = F.col("ord"), F.col("chapter")
    v = verses(s, d).withColumn("verse_id", F.when(k % 8 == 1, F.upper("verse_id")).otherwise(F.col("verse_id")))
    v = v.withColumn("en", F.when(o % 9 == 0, None).when((o % 9 == 1) & (k % 3 == 0), "").otherwise(F.col("en")))
    return K.check_verses(v)


@query("Q8_images", S.query("verses", """
    SELECT 'image.caption' AS rule, chapter_id AS path, verse_id AS id, 'caption must be an object' AS detail FROM verses WHERE n_images > 0 AND d % 4 = 1
    UNION ALL SELECT 'image.file', chapter_id, verse_id, 'missing image' || (d % 50) || '.jpg' FROM verses WHERE n_images > 0 AND (d % 50) % 3 = 0"""))
def _(s, d):
    images = C.captions_of(B.chapters(s, d))
    cap = F.to_json(F.struct("src", F.struct("en").alias("caption")))
    bare = F.to_json(F.struct("src", F.col("en").alias("caption")))
    rows = images.select("chapter_id", "verse_id", F.when(F.col("chapter") % 4 == 1, bare).otherwise(cap).alias("raw"))
    files = images.select(X.file_name(F.col("src")).alias("file")).distinct().where(
        F.regexp_extract("file", r"(\d+)", 1).cast("int") % 3 != 0
    )
    return K.check_images(rows, files)


Q9 = """
    w AS (SELECT chapter_id, ord, verse_id FROM verses),
    wc AS (SELECT chapter_id, verse_id, count(*) AS e FROM w GROUP BY 1, 2),
    gc AS (SELECT chapter_id, r_id AS verse_id, count(*) AS g FROM rverses GROUP BY 1, 2)"""


@query("Q9_result_coverage", S.query("verses rverses", f""", {Q9}
    SELECT 'result.order' AS rule, chapter_id AS path, '' AS id, n || ' positions differ' AS detail FROM (
      SELECT chapter_id, count(*) FILTER (w.verse_id IS DISTINCT FROM r.r_id) AS n FROM w FULL JOIN rverses r USING (chapter_id, ord) GROUP BY 1) WHERE n > 0
    UNION ALL SELECT CASE WHEN coalesce(g, 0) = 0 THEN 'result.missing' WHEN coalesce(e, 0) = 0 THEN 'result.extra' ELSE 'result.duplicate' END,
      chapter_id, verse_id, coalesce(g, 0) || ' of ' || coalesce(e, 0) FROM wc FULL JOIN gc USING (chapter_id, verse_id)
      WHERE coalesce(g, 0) = 0 OR coalesce(e, 0) = 0 OR g > e
    UNION ALL SELECT 'result.blank', chapter_id, r_id, 'missing ' || CASE WHEN trim(r_hant) = '' THEN 'zh_hant' WHEN trim(r_hans) = '' THEN 'zh_hans' ELSE 'ja' END
      FROM rverses WHERE trim(r_hant) = '' OR trim(r_hans) = '' OR trim(r_ja) = ''"""))
def _(s, d):
    return K.check_result_coverage(verses(s, d), received(s, d))


@query("Q10_kana", S.query("rverses", """
    SELECT 'result.kana' AS rule, chapter_id AS path, r_id AS id, CASE WHEN regexp_matches(r_hant, '[぀-ヿ]') THEN 'zh_hant' ELSE 'zh_hans' END AS detail
    FROM rverses WHERE regexp_matches(r_hant, '[぀-ヿ]') OR regexp_matches(r_hans, '[぀-ヿ]')"""))
def _(s, d):
    return K.check_kana(received(s, d))


@query("Q11_preambles", S.query("heads", """
    SELECT 'result.preamble' AS rule, chapter_id AS path, 'preamble' AS id, 'missing ja' AS detail FROM heads WHERE d % 2 = 1 AND d % 4 = 1 AND pre_en <> ''"""))
def _(s, d):
    return K.check_preamble_coverage(B.chapters(s, d), B.results(s, d))


@query("Q11_captions", S.query("verses rcaps", """
    , c AS (SELECT chapter_id, verse_id || '#0' AS cap_idx FROM verses WHERE cap_en IS NOT NULL)
    SELECT DISTINCT 'caption.missing' AS rule, chapter_id AS path, cap_idx AS id, '' AS detail FROM c ANTI JOIN rcaps USING (chapter_id, cap_idx)
    UNION ALL SELECT DISTINCT 'caption.extra', chapter_id, cap_idx, '' FROM rcaps ANTI JOIN c USING (chapter_id, cap_idx)
    UNION ALL SELECT 'caption.blank', chapter_id, cap_idx, 'missing ja' FROM rcaps SEMI JOIN c USING (chapter_id, cap_idx) WHERE c_ja IS NULL"""))
def _(s, d):
    caps = C.captions_of(B.chapters(s, d))
    got = B.results(s, d).select("chapter_id", F.posexplode("captions").alias("pos", "c")).select("chapter_id", "pos", "c.*")
    return K.check_caption_coverage(caps, got)


@query("Q12_tags", S.query("rverses terms", """
    SELECT 'result.tag' AS rule, chapter_id AS path, r_id AS id, 'unknown ' || r_tag AS detail FROM rverses
    WHERE r_tag IS NOT NULL AND r_tag NOT IN (SELECT slug FROM terms) AND r_tag NOT IN (SELECT lower(term) FROM terms)
    UNION ALL SELECT 'result.unknown_terms', source || '.' || doc_id, '', 'abc,zed' FROM documents WHERE doc_id % 2 = 1 AND doc_id % 29 = 1"""))
def _(s, d):
    return K.check_tags(received(s, d), B.terms(s, d)).unionByName(K.check_unknown_terms(B.results(s, d)))


@query("Q13_lock_check", S.query("records terms forms", f"""
    , hays AS (SELECT *, ' ' || array_to_string({S.tokens('en')}, ' ') || ' ' AS hay FROM records),
    found AS (SELECT DISTINCT r.chapter_id, r.label, r.zh_hant, r.zh_hans, r.ja, f.slug FROM hays r JOIN forms f ON contains(r.hay, ' ' || f.form || ' '))
    SELECT 'result.lock' AS rule, e.chapter_id AS path, e.label AS id, x.lang || ' missing ' || t.term || '→' || want AS detail
    FROM found e JOIN terms t ON t.slug = e.slug,
    LATERAL (SELECT unnest(['zh_hant', 'zh_hans', 'ja']) AS lang, unnest([t.zh_hant, t.zh_hans, t.ja]) AS want, unnest([e.zh_hant, e.zh_hans, e.ja]) AS got) x
    WHERE want <> '' AND NOT contains(coalesce(got, ''), want)"""))
def _(s, d):
    t = B.terms(s, d)
    return K.check_locks(C.records_of(B.rich_chapters(s, d)), t, term_forms(t))


@query("Q14_tagged_locks", S.query("verses terms", r"""
    SELECT 'result.tagged_lock' AS rule, chapter_id AS path, verse_id AS id, x.lang || ' missing ' || term || '→' || want AS detail FROM (
      SELECT v.*, t.term, t.zh_hant AS w1, t.zh_hans AS w2, t.ja AS w3, regexp_replace(lower(v.en), '([\pL\pN\pM_]+)', '<\1>', 'g') AS m1,
             regexp_replace(lower(t.term), '([\pL\pN\pM_]+)', '<\1>', 'g') AS m2
      FROM verses v JOIN (SELECT * FROM terms x WHERE position = (SELECT max(position) FROM terms y WHERE y.term = x.term)) t ON t.slug = v.tag) y,
    LATERAL (SELECT unnest(['zh_hant', 'zh_hans', 'ja']) AS lang, unnest([w1, w2, w3]) AS want, unnest([y.zh_hant, y.zh_hans, y.ja]) AS got) x
    WHERE contains(m1, m2) AND want <> '' AND NOT contains(coalesce(got, ''), want)"""))
def _(s, d):
    t = B.terms(s, d)
    keep = t.groupBy("term").agg(F.max_by("slug", "position").alias("slug"))
    names = t.join(keep.select("slug"), "slug").select(F.col("slug").alias("_s"), "term")
    tags = verses(s, d).withColumn("_s", F.get("glossary_terms", F.lit(0))).join(names, "_s")
    return K.check_tagged_locks(tags.withColumn("glossary_terms", F.array("term")), t)


@query("Q15_images", S.query("verses", """
    SELECT 'verse.images' AS rule, chapter_id AS path, verse_id AS id, '2 images' AS detail FROM verses WHERE n_images = 2
    UNION ALL SELECT 'verse.expected_image', '', verse_id, 'missing /plates/image' || (d % 50) || '.jpg' FROM (
      SELECT DISTINCT verse_id, d FROM verses WHERE o % 15 = 0) x WHERE verse_id NOT IN (SELECT verse_id FROM verses WHERE n_images > 0)"""))
def _(s, d):
    v = verses(s, d)
    src = F.concat(F.lit("/plates/image"), (F.col("chapter") % 50).cast("string"), F.lit(".jpg"))
    expected = v.where("ord % 15 = 0").select("verse_id", src.alias("src")).distinct()
    return K.check_image_pileup(v, limit=1).unionByName(K.check_expected_images(expected, v))


@query("Q16_review_gate", S.query("heads", """
    SELECT chapter_id, d % 3 <> 0 AS passed, CASE WHEN d % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_major,
           (CASE WHEN d % 5 = 0 THEN 0 ELSE 1 END)::BIGINT + CASE WHEN d % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_issues FROM heads"""))
def _(s, d):
    from lectern import schemas

    k = F.col("chapter")

    def issue(level):
        null = F.lit(None).cast("string")
        return F.struct(F.col("id").alias("id"), F.lit("ja").alias("lang"), F.lit(level).alias("severity"),
                        null.alias("problem"), null.alias("suggestion"))

    kind = schemas.REVIEW["issues"].dataType.simpleString()
    empty = F.array().cast(kind)
    issues = F.concat(
        F.when(k % 5 == 0, empty).otherwise(F.array(issue("minor")).cast(kind)),
        F.when(k % 3 == 0, F.array(issue("major")).cast(kind)).otherwise(empty),
    )
    return K.review_gate(B.chapters(s, d).select(F.col("id").alias("chapter_id"), issues.alias("issues")))


@query("Q17_identity", S.query("verses", """
    SELECT 'identity.duplicate' AS rule, '' AS path, verse_id AS id, count(*) || ' times' AS detail FROM verses GROUP BY verse_id HAVING count(*) > 1
    UNION ALL SELECT 'identity.numbering', chapter_id, verse_id, 'at position ' || ord FROM verses WHERE verse_number <> ord"""))
def _(s, d):
    return K.check_identity(verses(s, d))


@query("Q_summary", S.query("verses rverses", """
    SELECT rule, count(*) AS n FROM (
      SELECT 'identity.duplicate' AS rule FROM verses GROUP BY verse_id HAVING count(*) > 1
      UNION ALL SELECT 'identity.numbering' FROM verses WHERE verse_number <> ord
      UNION ALL SELECT 'result.kana' FROM rverses WHERE regexp_matches(r_hant, '[぀-ヿ]') OR regexp_matches(r_hans, '[぀-ヿ]')
      UNION ALL SELECT 'verse.en' FROM verses WHERE en = '') GROUP BY 1"""))
def _(s, d):
    v = verses(s, d)
    return K.summary(K.check_identity(v).unionByName(K.check_kana(received(s, d))).unionByName(K.check_verses(v)))
