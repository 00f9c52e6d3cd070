"""Column functions over every line of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.unicode import normalise
from lectern.operators import corpus as C
from lectern.plans import binding as B
from lectern.plans import sql as S
from lectern.plans.registry import query


def lines(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("d"), "source", "lang", F.posexplode(F.split("text", "\n")).alias("_i", "en")
    ).withColumn("o", (F.col("_i") + 1).cast("bigint")).drop("_i")


SP = r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{SP}*\\bp\\.{SP}*[0-9]+{SP}*', ' ', 'g'), '{SP}+', ' ', 'g'))"


MARKED_SQL = "replace(en, ', ', '  p. ' || o || ' ')"


@query("P1_collapse", S.query("v0", f"SELECT d, o, {sql_collapse(MARKED_SQL)} AS text FROM v0"))
def _(s, d):
    marked = F.replace(F.col("en"), F.lit(", "), F.concat(F.lit("  p. "), F.col("o").cast("string"), F.lit(" ")))
    return lines(s, d).select("d", "o", X.collapse(marked).alias("text"))


@query("P2_parse_verse", S.query("v0", f"""
    SELECT d, o, regexp_matches(t, '(?s)^([0-9]+)\\.\\s+(.*)') AND rest <> '' AS is_verse,
           CASE WHEN regexp_matches(t, '(?s)^([0-9]+)\\.\\s+(.*)') AND rest <> ''
                THEN TRY_CAST(regexp_extract(t, '(?s)^([0-9]+)\\.\\s+(.*)', 1) AS BIGINT) END AS number,
           CASE WHEN regexp_matches(t, '(?s)^([0-9]+)\\.\\s+(.*)') AND rest <> '' THEN rest ELSE '' END AS rest
    FROM (SELECT d, o, t, {sql_collapse("regexp_extract(t, '(?s)^([0-9]+)\\.\\s+(.*)', 2)")} AS rest
    FROM (SELECT d, o, {sql_collapse("CASE WHEN o % 4 = 0 THEN en WHEN o % 4 = 1 THEN o || '.' || en ELSE o || '.  ' || en END")} AS t
    FROM v0))"""))
def _(s, d):
    o = F.col("o").cast("string")
    raw = F.when(F.col("o") % 4 == 0, F.col("en")).when(
        F.col("o") % 4 == 1, F.concat(o, F.lit("."), "en")
    ).otherwise(F.concat(o, F.lit(".  "), "en"))
    return lines(s, d).select("d", "o", X.parse_verse(raw).alias("v")).select("d", "o", "v.*")


@query("P3_split_anchor", S.query("v0", """
    SELECT d, o, nullif(regexp_extract(name, '^(.+?)(\\d+)$', 1), '') AS prefix,
           TRY_CAST(nullif(regexp_extract(name, '^(.+?)(\\d+)$', 2), '') AS BIGINT) AS number,
           a.slug
    FROM (SELECT d, o, CASE WHEN d % 5 = 0 THEN book || '_' ELSE book || CASE WHEN d % 2 = 0 THEN '_' ELSE 'Bk' END || o END AS name FROM v0) n
    LEFT JOIN (SELECT DISTINCT source || '_' AS key, source AS slug FROM documents) a
      ON nullif(regexp_extract(name, '^(.+?)(\\d+)$', 1), '') = a.key"""))
def _(s, d):
    name = F.when(F.col("d") % 5 == 0, F.concat("source", F.lit("_"))).otherwise(
        F.concat("source", F.when(F.col("d") % 2 == 0, "_").otherwise("Bk"), F.col("o").cast("string"))
    )
    parts = lines(s, d).select("d", "o", X.split_anchor(name).alias("p")).select("d", "o", "p.*")
    keys = B.anchors(s, d).where("kind = 'chapter'").select(F.col("key").alias("prefix"), "slug")
    return parts.join(keys, "prefix", "left").select("d", "o", "prefix", "number", "slug")


@query("P4_slugify", S.query("v0", """
    SELECT d, o, regexp_replace(regexp_replace(lower(en), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM v0"""))
def _(s, d):
    return lines(s, d).select("d", "o", X.slugify(F.col("en")).alias("slug"))


@query("P5_title_from_slug", S.query("v0", """
    SELECT d, o, array_to_string(list_transform(string_split(
        replace(regexp_replace(regexp_replace(regexp_replace(lower(en), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'),
                '([0-9])([a-z])', '\\1~\\2', 'g'), '-', ' '), ' '),
        lambda w: array_to_string(list_transform(string_split(w, '~'), lambda p: upper(p[1]) || p[2:]), '')), ' ') AS title
    FROM v0"""))
def _(s, d):
    return lines(s, d).select("d", "o", X.title_from_slug(X.slugify(F.col("en"))).alias("title"))


@query("P6_make_ids", S.query("v0 books", """
    SELECT d, o, v0.book || '.' || d AS chapter_id, v0.book || '.' || d || '.' || o AS verse_id,
           coalesce(b.title, v0.book) || ' — Chapter ' || d AS title
    FROM v0 LEFT JOIN books b ON b.slug = v0.book"""))
def _(s, d):
    names = B.books(s, d).select(F.col("slug").alias("source"), "title")
    rows = lines(s, d).join(names, "source", "left")
    src, ch = F.col("source"), F.col("d")
    return rows.select(
        "d", "o", X.chapter_id(src, ch).alias("chapter_id"), X.verse_id(src, ch, F.col("o")).alias("verse_id"),
        X.chapter_title(F.col("title"), src, ch).alias("title"),
    )


VID_SQL = "CASE WHEN o % 7 = 0 THEN chapter_id WHEN o % 7 = 1 THEN 'A.' || verse_id ELSE verse_id END"


@query("P7_parse_verse_id", S.query("verses", f"""
    SELECT d, ord, regexp_matches(vid, '^[a-z0-9-]+\\.\\d+\\.\\d+$') AS strict,
           CASE WHEN hit THEN regexp_extract(vid, '^(.+)\\.(\\d+)\\.(\\d+)$', 1) END AS book,
           CASE WHEN hit THEN regexp_extract(vid, '^(.+)\\.(\\d+)\\.(\\d+)$', 2)::BIGINT END AS chapter,
           CASE WHEN hit THEN regexp_extract(vid, '^(.+)\\.(\\d+)\\.(\\d+)$', 3)::BIGINT END AS verse
    FROM (SELECT d, ord, {VID_SQL} AS vid, regexp_matches({VID_SQL}, '^(.+)\\.(\\d+)\\.(\\d+)$') AS hit FROM verses)"""))
def _(s, d):
    v = C.verses_of(B.chapters(s, d))
    vid = F.when(F.col("ord") % 7 == 0, F.col("chapter_id")).when(
        F.col("ord") % 7 == 1, F.concat(F.lit("A."), "verse_id")
    ).otherwise(F.col("verse_id"))
    return v.select(
        F.col("chapter").alias("d"), "ord", X.is_verse_id(vid).alias("strict"), X.parse_verse_id(vid).alias("p")
    ).select("d", "ord", "strict", "p.*")


@query("P8_i18n_wrap", S.query("v0", """
    SELECT d, o, nullif(en, '') AS en, NULL::VARCHAR AS zh_hant, NULL::VARCHAR AS zh_hans, NULL::VARCHAR AS ja FROM v0"""))
def _(s, d):
    return lines(s, d).select("d", "o", X.i18n_wrap(F.col("en")).alias("t")).select("d", "o", "t.*")


@query("P9_i18n_normalise", S.query("heads", """
    SELECT d, CASE WHEN d % 4 = 0 THEN text WHEN d % 4 = 1 THEN '' ELSE pre_en END AS en,
           CASE WHEN d % 4 IN (2, 3) THEN pre_hant END AS zh_hant FROM heads"""))
def _(s, d):
    docs = B.table(s, d, "documents").select("doc_id", "text")
    chapters = B.chapters(s, d).select(F.col("chapter").alias("doc_id"), "preamble")
    k = F.col("doc_id") % 4
    # Old style: a bare JSON string; a JSON null; else the object.
    bare = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    raw = F.when(k == 0, bare).when(k == 1, "null").otherwise(
        F.to_json("preamble", {"ignoreNullFields": "false"})
    )
    rows = docs.join(chapters, "doc_id").select("doc_id", X.i18n_normalise(raw).alias("t"))
    return rows.select(F.col("doc_id").alias("d"), "t.en", "t.zh_hant")


@query("P10_i18n_get", S.query("verses", """
    SELECT chapter_id, ord, coalesce(nullif(zh_hant, ''), en, '') AS hant, coalesce(nullif(ja, ''), en, '') AS ja FROM verses"""))
def _(s, d):
    v = C.verses_of(B.chapters(s, d)).withColumn("t", F.struct("en", "zh_hant", "zh_hans", "ja"))
    return v.select(
        "chapter_id", "ord", X.i18n_get(F.col("t"), "zh_hant").alias("hant"), X.i18n_get(F.col("t"), "ja").alias("ja")
    )


@query("P12_sha16", S.query("v0", f"SELECT d, o, {S.sha16('en')} AS sha FROM v0"))
def _(s, d):
    return lines(s, d).select("d", "o", X.sha16(F.col("en")).alias("sha"))


@query("P13_normalise", S.query("v0", f"SELECT d, o, {S.norm('en')} AS normal FROM v0"))
def _(s, d):
    return lines(s, d).select("d", "o", normalise(F.col("en")).alias("normal"))


@query("P14_tokenize", S.query("v0", f"""
    SELECT d, o, array_to_string({S.tokens('en')}, ' ') AS tokens, len({S.tokens('en')})::BIGINT AS n FROM v0"""))
def _(s, d):
    tok = lines(s, d).select("d", "o", X.tokenize(F.col("en")).alias("t"))
    return tok.select("d", "o", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@query("P15_ngrams", S.query("v0", f"""
    SELECT gram, count(*) AS n_lines FROM (
      SELECT DISTINCT d, o, gram FROM (
        SELECT d, o, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram
        FROM (SELECT d, o, {S.tokens('en')} AS t FROM v0) WHERE len(t) >= 2)) GROUP BY 1"""))
def _(s, d):
    tok = lines(s, d).select(X.once(X.tokenize(F.col("en"))).alias("t"))
    grams = tok.select(F.explode(X.ngrams(F.col("t"), [2])).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n_lines"))


@query("P16_contains_seq", S.query("v0", f"""
    SELECT d, o, len(p) > 0 AND contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(p[1:2], ' ') || ' ') AS hit FROM (
      SELECT v0.d, v0.o, {S.tokens('v0.en')} AS t, {S.tokens('doc_head')} AS p
      FROM v0 JOIN (SELECT doc_id, string_split(text, chr(10))[1] AS doc_head FROM documents) h ON h.doc_id = v0.d)"""))
def _(s, d):
    docs = B.table(s, d, "documents").select(
        F.col("doc_id").alias("d"), X.tokenize(F.get(F.split("text", "\n"), F.lit(0))).alias("p"),
        F.posexplode(F.split("text", "\n")).alias("i", "en"),
    )
    # A first line of one word is asked for as that word; one without words is held by no line.
    form = F.array_join(F.slice("p", 1, 2), " ")
    return docs.select("d", (F.col("i") + 1).alias("o"), X.contains_seq(X.tokenize(F.col("en")), form).alias("hit"))


@query("P17_phrase_forms", S.query("forms", "SELECT slug, form, len(string_split(form, ' '))::BIGINT AS n FROM forms"))
def _(s, d):
    from lectern.operators.terms import term_forms

    return term_forms(B.terms(s, d))


P18_IN = """CASE WHEN o % 9 = 0 THEN 'p. ' || o WHEN o % 9 = 1 THEN 'P. xv' WHEN o % 9 = 2 THEN 'p. ' || o || 'a'
    WHEN o % 9 = 3 THEN 'Chapter ' || o WHEN o % 9 = 4 THEN 'CHAPTER ' || o || '. ' || en WHEN o % 9 = 5 THEN upper(book) || '.' ELSE en END"""


@query("P18_headings", S.query("v0", f"""
    SELECT d, o, regexp_matches(t, '(?i)^p\\.\\s*[\\divxlcdm]+\\s*$') AS page_mark,
           regexp_matches(t, '(?i)^p\\.\\s+\\S+$') AS any_page_mark,
           regexp_matches(t, '^Chapter\\s+[\\dIVXLCivxlc]+\\s*$') AS chapter_heading,
           regexp_matches(t, '(?i)^chapter\\s+\\d+') AS starts_chapter,
           regexp_matches(t, '(?i)^CHAPTER\\s+\\d+\\.') AS numbered_chapter,
           lower(trim(t)) = lower(book) OR regexp_replace(lower(trim(t)), '\\.+$', '') = lower(book) AS is_title
    FROM (SELECT d, o, book, {P18_IN} AS t FROM v0)"""))
def _(s, d):
    o = F.col("o").cast("string")
    k = F.col("o") % 9
    t = (
        F.when(k == 0, F.concat(F.lit("p. "), o)).when(k == 1, "P. xv")
        .when(k == 2, F.concat(F.lit("p. "), o, F.lit("a"))).when(k == 3, F.concat(F.lit("Chapter "), o))
        .when(k == 4, F.concat(F.lit("CHAPTER "), o, F.lit(". "), "en"))
        .when(k == 5, F.concat(F.upper("source"), F.lit("."))).otherwise(F.col("en"))
    )
    rows = lines(s, d).withColumn("t", t)
    c = F.col("t")
    return rows.select(
        "d", "o", X.is_page_mark(c).alias("page_mark"), X.is_any_page_mark(c).alias("any_page_mark"),
        X.is_chapter_heading(c).alias("chapter_heading"), X.starts_chapter(c).alias("starts_chapter"),
        X.is_numbered_chapter(c).alias("numbered_chapter"), X.same_heading(c, F.col("source")).alias("is_title"),
    )


@query("P19_headword", S.query("v0", """
    SELECT d, o, term, trim(regexp_replace(en[len(term) + 1:], '^[ .—–:-]+', '')) AS definition,
           len(term) > 0 AND len(term) < 80 AS keep
    FROM (SELECT d, o, en, regexp_replace(regexp_extract(en, '^[^ ]*( [^ ]*)?', 0), '[.,:;]+$', '') AS term FROM v0)"""))
def _(s, d):
    head = X.clean_headword(F.regexp_extract("en", "^[^ ]*( [^ ]*)?", 0))
    return lines(s, d).select("d", "o", "en", head.alias("term")).select(
        "d", "o", "term", X.clean_definition(F.col("en"), F.col("term")).alias("definition"),
        X.keep_headword(F.col("term")).alias("keep"),
    )


@query("P20_plate_ref", S.query("elements", """
    SELECT page_id, pos, regexp_replace(f, '\\.jpg$', '') AS stem,
           CASE WHEN regexp_extract(f, '(\\d+)', 1)::BIGINT % 2 = 0 THEN regexp_extract(f, '(\\d+)', 1)::BIGINT END AS plate_ref
    FROM (SELECT page_id, pos, string_split(src, '/')[-1] AS f FROM elements WHERE src IS NOT NULL)"""))
def _(s, d):
    from lectern.operators.segment import plate_refs

    e = B.elements(s, d).where("src is not null").withColumn("src", F.concat(F.lit("img/"), X.file_name(F.col("src"))))
    plates = e.select(
        X.image_stem(F.col("src")).alias("img_id"), F.regexp_extract("src", r"(\d+)", 1).cast("bigint").alias("id")
    ).distinct().where("id % 2 = 0")
    return plate_refs(e, plates).select("page_id", "pos", X.image_stem(F.col("src")).alias("stem"), "plate_ref")


@query("P21_caption_map", S.query("elements", """
    SELECT page_id, pos, f AS file, CASE WHEN n % 3 = 0 THEN 'Caption ' || n END AS caption, n % 3 = 0 AS has_caption
    FROM (SELECT page_id, pos, string_split(src, '/')[-1] AS f, regexp_extract(src, 'image(\\d+)', 1)::BIGINT AS n
          FROM elements WHERE src IS NOT NULL AND contains(lower(src), '_files/image'))"""))
def _(s, d):
    e = B.elements(s, d).where(X.is_content_image(F.col("src"))).withColumn("file", X.file_name(F.col("src")))
    n = F.regexp_extract("file", r"(\d+)", 1)
    captions = e.select("file", F.when(n.cast("int") % 3 == 0, F.concat(F.lit("Caption "), n)).alias("caption")).distinct()
    return e.join(captions, "file", "left").select(
        "page_id", "pos", "file", "caption", F.col("caption").isNotNull().alias("has_caption")
    )


@query("P22_clean_agent_json", S.query("heads", """
    SELECT d, CASE WHEN d % 4 = 3 THEN NULL ELSE chapter_id END AS chapter_id,
           CASE WHEN d % 4 = 3 THEN NULL ELSE d % 2 = 0 END AS pass FROM heads"""))
def _(s, d):
    from lectern import schemas

    docs = B.table(s, d, "documents")
    k = F.col("doc_id")
    body = F.to_json(F.struct(
        F.concat_ws(".", "source", k.cast("string")).alias("chapter_id"), (k % 2 == 0).alias("pass"),
        F.array(F.struct(F.col("text").alias("problem"))).alias("issues"),
    ))
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```  ")))
        .when(k % 4 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" done")))
        .when(k % 4 == 2, body).otherwise(F.translate("text", "{}", ""))
    )
    parsed = F.from_json(X.clean_agent_json(raw), schemas.REVIEW, {"mode": "PERMISSIVE"})
    return docs.select(k.alias("d"), parsed.alias("r")).select("d", "r.chapter_id", "r.pass")


@query("P24_script", S.query("verses", """
    SELECT chapter_id, ord, coalesce(regexp_matches(zh_hant, '[぀-ゟ゠-ヿ]'), false) AS kana_hant,
           coalesce(regexp_matches(ja, '[゠-ヿ]'), false) AS katakana_ja FROM verses"""))
def _(s, d):
    return C.verses_of(B.chapters(s, d)).select(
        "chapter_id", "ord", X.has_kana(F.col("zh_hant")).alias("kana_hant"), X.has_katakana(F.col("ja")).alias("katakana_ja")
    )


@query("P27_overflow_list", S.query("v0", f"""
    SELECT d, array_to_string(t[1:12], ', ') || CASE WHEN len(t) > 12 THEN ' … (+' || (len(t) - 12) || ')' ELSE '' END AS shown
    FROM (SELECT doc_id AS d, {S.tokens('text')} AS t FROM documents)"""))
def _(s, d):
    t = B.table(s, d, "documents").select(F.col("doc_id").alias("d"), X.tokenize(F.col("text")).alias("t"))
    return t.select("d", X.overflow_list(F.col("t")).alias("shown"))


@query("P28_pct", S.query("verses", """
    SELECT chapter_id, n || '/' || total || ' (' || CASE WHEN total = 0 THEN 0 ELSE 100 * n // total END || '%)' AS share
    FROM (SELECT chapter_id, count(*) FILTER (ja <> '') AS n, count(*) FILTER (d % 8 <> 0) AS total FROM verses GROUP BY 1)"""))
def _(s, d):
    n = F.size(F.filter("verses", lambda v: v["ja"] != ""))
    total = F.when(F.col("chapter") % 8 != 0, F.size("verses")).otherwise(0)
    return B.chapters(s, d).select(F.col("id").alias("chapter_id"), X.pct(n, total).alias("share"))


@query("P29_caption_key", S.query("verses", """
    SELECT chapter_id, ord, verse_id || '#0' AS cap_idx, cap_en AS en FROM verses WHERE cap_en IS NOT NULL"""))
def _(s, d):
    return C.captions_of(B.chapters(s, d)).select("chapter_id", "ord", "cap_idx", "en")


@query("P30_null_fields", S.query("stored", """
    SELECT slug, concat_ws(',', CASE WHEN coalesce(hant, '') = '' OR coalesce(hans, '') = '' OR coalesce(ja, '') = '' THEN 'translit' END,
        CASE WHEN d % 2 = 0 THEN 'def' END, 'note') AS missing FROM stored"""))
def _(s, d):
    return B.stored_terms(s, d).select("slug", X.null_field_digest(
        F.col("translit"), F.col("source_def"), F.col("source_def_literal"), F.col("editor_note")
    ).alias("missing"))


@query("P31_glossary_view", S.query("stored", """
    SELECT slug, ja AS ja_rendering, NULL::VARCHAR AS ja_note, 'ル' AS ja_literal,
           NULL::VARCHAR AS en_rendering, 'n' AS en_note, NULL::VARCHAR AS en_literal FROM stored"""))
def _(s, d):
    t = B.stored_terms(s, d)
    args = (F.col("translit"), F.col("editor_note"), F.col("source_def_literal"))
    rows = t.select("slug", X.glossary_view(*args, "ja").alias("j"), X.glossary_view(*args, "en").alias("e"))
    return rows.select(
        "slug", *[F.col(f"j.{k}").alias(f"ja_{k}") for k in ("rendering", "note", "literal")],
        *[F.col(f"e.{k}").alias(f"en_{k}") for k in ("rendering", "note", "literal")],
    )
