"""Dictionary linking, annotation and search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.operators import search as Q
from lectern.operators import terms as T
from lectern.operators.sizing import small_side
from lectern.plans import binding as B
from lectern.plans import sql as S
from lectern.plans.registry import query
from lectern.session import cut_lineage, shared_folder

KEYS = ["book", "chapter", "chapter_id", "ord", "verse_id"]


def verses(s, d):
    return C.verses_of(B.chapters(s, d))


def edges(s, d):
    return T.token_edges(verses(s, d), "en", KEYS, T.term_forms(B.terms(s, d)))


def kept_edges(s, d):
    """Edges for plans that read them several times: small beside the text they come from."""
    return cut_lineage(edges(s, d))


def placed_edges(s, d):
    """First links by the word rule, with the position of their book."""
    ch = B.chapters(s, d)
    order = C.number_books(ch, B.books(s, d)).select("book", F.col("position").alias("book_position"))
    found = T.word_edges(verses(s, d), "en", KEYS, B.terms(s, d))
    return cut_lineage(T.first_links(found.join(small_side(order), "book")))


# Every word is put in angle brackets, on both sides; containment then means \b term \b.
MARK = r"regexp_replace(lower({}), '([\pL\pN\pM_]+)', '<\1>', 'g')"
WEDGES = f"""
    wv AS MATERIALIZED (SELECT *, {MARK.format('en')} AS marked FROM verses),
    wt AS MATERIALIZED (SELECT *, {MARK.format('term')} AS marked FROM terms),
    wedges AS (SELECT v.book, v.chapter, v.chapter_id, v.ord, v.verse_id, v.tag, t.slug, t.position, t.term
               FROM wv v JOIN wt t ON contains(v.marked, t.marked))"""

# Only the first verse of a repeated id is a link.
EDGE_ORDER = f"""
    {WEDGES.strip()},
    pos AS (SELECT source AS book, row_number() OVER (ORDER BY position NULLS LAST, source) AS bp
            FROM (SELECT DISTINCT source FROM documents) LEFT JOIN books b ON slug = source),
    firsts AS (SELECT w.slug, w.verse_id, bp, w.chapter, w.ord FROM wedges w JOIN pos USING (book)
               QUALIFY row_number() OVER (PARTITION BY w.slug, w.verse_id ORDER BY bp, w.chapter, w.ord) = 1),
    linked AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY bp, chapter, ord) AS link_no FROM firsts)"""


@query("J4_term_match", S.query("edges", "SELECT * FROM edges"))
def _(s, d):
    return edges(s, d)


@query("J5_term_regex", S.query("verses terms", f", {WEDGES} SELECT chapter_id, ord, slug FROM wedges"))
def _(s, d):
    return T.word_edges(verses(s, d), "en", ["chapter_id", "ord"], B.terms(s, d))


TAG_SQL = "CASE WHEN v.o % 3 = 0 THEN t.term WHEN v.o % 3 = 1 THEN upper(t.term) ELSE t.term || '?' END"


def tagged(s, d):
    """Tags on every fifth verse: headword, headword in capitals, or an unknown word."""
    names = B.terms(s, d).select(F.col("slug").alias("_s"), F.col("term").alias("_t"))
    rows = verses(s, d).select("chapter_id", "ord", "verse_number", "en", *X.LANGS, F.explode("glossary_terms").alias("_s")).join(names, "_s")
    k = F.col("ord") % 3
    tag = F.when(k == 0, F.col("_t")).when(k == 1, F.upper("_t")).otherwise(F.concat("_t", F.lit("?")))
    return rows.select("chapter_id", "ord", "verse_number", "en", *X.LANGS, tag.alias("tag"), F.lit(0).alias("tag_no"))


@query("J6_tag_resolution", S.query("verses terms", f"""
    SELECT chapter_id, ord, tag, coalesce(
        (SELECT arg_max(slug, position) FROM terms x WHERE x.term = tag),
        (SELECT arg_max(slug, position) FROM terms x WHERE lower(x.term) = lower(tag))) AS slug
    FROM (SELECT v.chapter_id, v.ord, {TAG_SQL} AS tag FROM verses v JOIN terms t ON t.slug = v.tag WHERE v.o % 3 <> 2)"""))
def _(s, d):
    return T.resolve_tags(tagged(s, d), "tag", B.terms(s, d)).select("chapter_id", "ord", "tag", "slug")


@query("J7_select_for_scope", S.query("records terms forms", f"""
    , scoped AS (SELECT chapter_id, ' ' || array_to_string({S.tokens("string_agg(en, chr(10) ORDER BY ord, part)")}, ' ') || ' ' AS hay
                 FROM records WHERE label = 'preamble' OR verse_number BETWEEN 2 AND 40 GROUP BY 1)
    SELECT DISTINCT chapter_id, slug FROM scoped JOIN forms ON contains(hay, ' ' || form || ' ')
    UNION SELECT v.chapter_id, (SELECT arg_max(slug, position) FROM terms x WHERE x.term = t.term)
    FROM verses v JOIN terms t ON t.slug = v.tag WHERE v.o % 3 <> 2 AND v.verse_number BETWEEN 2 AND 40"""))
def _(s, d):
    # The texts of a scope are one text: a term may run on from one record to the next.
    ch = B.rich_chapters(s, d)
    text = C.text_of(ch, ["en"], lambda v: C.in_verse_range(v["verse_number"], 2, 40))
    found = T.token_edges(ch.select(F.col("id").alias("chapter_id"), text.alias("text")), "text", ["chapter_id"], T.term_forms(B.terms(s, d)))
    tags = T.resolve_tags(tagged(s, d), "tag", B.terms(s, d)).where(C.in_verse_range(F.col("verse_number"), 2, 40))
    return T.scope_terms(found, tags, ["chapter_id"])


RENDERED = """
    rendered AS (
      SELECT DISTINCT v.chapter_id, t.slug FROM verses v JOIN terms t ON t.slug = v.tag
      UNION SELECT DISTINCT v.chapter_id, t.slug FROM records v JOIN terms t
        ON contains(v.zh_hant, t.zh_hant) OR contains(v.zh_hans, t.zh_hant) OR contains(v.ja, t.zh_hant)
        OR contains(v.zh_hant, t.zh_hans) OR contains(v.zh_hans, t.zh_hans) OR contains(v.ja, t.zh_hans)
        OR contains(v.zh_hant, t.ja) OR contains(v.zh_hans, t.ja) OR contains(v.ja, t.ja))"""


def rendered_terms(s, d):
    """(chapter_id, slug): tagged on a verse, or rendered in any verse, preamble or caption."""
    ch = B.rich_chapters(s, d)
    tags = C.verses_of(ch).select("chapter_id", F.explode("glossary_terms").alias("slug"))
    text = ch.select(F.col("id").alias("chapter_id"), C.text_of(ch, X.LANGS).alias("text"))
    return T.glossary_slice(tags, text, B.terms(s, d))


@query("J8_chapter_glossary_slice", S.query("records terms", f", {RENDERED} SELECT * FROM rendered"))
def _(s, d):
    return rendered_terms(s, d)


@query("A4_backlinks", S.query("verses books terms", f""",{EDGE_ORDER}
    SELECT t.slug, coalesce((link_no - 1) // 1000, 0) AS part_no, coalesce(string_agg(verse_id, ',' ORDER BY link_no), '') AS verse_ids
    FROM terms t LEFT JOIN linked l ON l.slug = t.slug GROUP BY 1, 2"""))
def _(s, d):
    return T.backlinks(placed_edges(s, d), B.terms(s, d)).select(
        "slug", "part_no", F.array_join("verse_ids", ",").alias("verse_ids")
    )


@query("A4_backlink_summary", S.query("verses books terms", f""",{EDGE_ORDER}
    SELECT t.slug, count(link_no) AS n_links, coalesce(string_agg(verse_id, ', ' ORDER BY link_no) FILTER (link_no <= 12), '')
           || CASE WHEN count(link_no) > 12 THEN ' … (+' || (count(link_no) - 12) || ')' ELSE '' END AS appears
    FROM terms t LEFT JOIN linked l ON l.slug = t.slug GROUP BY 1"""))
def _(s, d):
    return T.backlink_summary(placed_edges(s, d), B.terms(s, d))


@query("A5_verse_tags", S.query("edges terms", """
    SELECT chapter_id, ord, string_agg(slug, ',' ORDER BY position) AS tags FROM edges JOIN terms USING (slug) GROUP BY 1, 2"""))
def _(s, d):
    return T.verse_tags(edges(s, d), B.terms(s, d), ["chapter_id", "ord"]).select(
        "chapter_id", "ord", F.array_join("tags", ",").alias("tags")
    )


@query("A6_total_links", S.query("verses terms", f""", {WEDGES}
    SELECT count(*) AS total_links, count(DISTINCT slug) AS linked_terms FROM (SELECT DISTINCT verse_id, slug FROM wedges)"""))
def _(s, d):
    links = T.word_edges(verses(s, d), "en", ["verse_id"], B.terms(s, d))
    per_term = T.link_counts(links, B.terms(s, d))
    return per_term.agg(
        F.sum("n_links").alias("total_links"), F.count_if(F.col("n_links") > 0).alias("linked_terms")
    )


@query("T1_link_terms", S.query("verses terms", f""", {WEDGES}
    SELECT v.chapter, v.ord, coalesce(w.tags, '') AS tags FROM verses v
    LEFT JOIN (SELECT chapter, ord, string_agg(slug, ',' ORDER BY position) AS tags FROM wedges GROUP BY 1, 2) w
      ON w.chapter = v.chapter AND w.ord = v.ord
    WHERE coalesce(w.tags, '') <> coalesce(v.tag, '')"""))
def _(s, d):
    _, changed, _ = T.link_terms(verses(s, d), B.terms(s, d), B.books(s, d))
    return changed.select("chapter", "ord", F.array_join("glossary_terms", ",").alias("tags"))


@query("T1_link_total", S.query("verses terms", f""", {WEDGES}
    SELECT count(*) AS total_links FROM (SELECT DISTINCT verse_id, slug FROM wedges)"""))
def _(s, d):
    return T.link_terms(verses(s, d), B.terms(s, d), B.books(s, d))[2]


@query("T2_select_terms", S.query("edges", "SELECT book, slug, count(*) AS n_verses, min(chapter) AS first_chapter FROM edges GROUP BY 1, 2"))
def _(s, d):
    return edges(s, d).groupBy("book", "slug").agg(
        F.count(F.lit(1)).alias("n_verses"), F.min("chapter").alias("first_chapter")
    )


T3_SQL = f"""
    SELECT v.chapter_id, v.ord, v.en = '' OR regexp_matches(v.en, '(?i)(^|[^A-Za-z])' || t.term || '([^A-Za-z]|$)')
      OR (len(regexp_replace(t.term, '[^A-Za-z]', '', 'g')) >= 4
          AND regexp_matches(v.en, '(?i)(^|[^A-Za-z])' || regexp_replace(t.term, '[^A-Za-z]', '', 'g')[1:4])) AS present
    FROM verses v JOIN terms t ON t.slug = v.tag"""


@query("T3_bilingual_presence", S.query("verses terms", T3_SQL))
def _(s, d):
    rows = verses(s, d).select("chapter_id", "ord", "en", F.explode("glossary_terms").alias("slug")).join(
        B.terms(s, d).select("slug", "term"), "slug"
    )
    return rows.select("chapter_id", "ord", T.english_present(F.col("term"), F.col("en")).alias("present"))


# Renderings as one alternation, longest first; cut the text at the hits and join it again.
ANNOTATED = """
    , best AS (
      SELECT e.chapter_id, e.ord, t.zh_hans AS tl, arg_min(t.term, t.position) AS term
      FROM edges e JOIN terms t USING (slug) JOIN verses v ON v.chapter_id = e.chapter_id AND v.ord = e.ord
      WHERE v.en = '' OR regexp_matches(v.en, '(?i)(^|[^A-Za-z])' || t.term || '([^A-Za-z]|$)')
         OR (len(regexp_replace(t.term, '[^A-Za-z]', '', 'g')) >= 4
             AND regexp_matches(v.en, '(?i)(^|[^A-Za-z])' || regexp_replace(t.term, '[^A-Za-z]', '', 'g')[1:4]))
      GROUP BY 1, 2, 3),
    pats AS (SELECT chapter_id, ord, string_agg(tl, '|' ORDER BY length(tl) DESC, tl) AS pat,
                    map(list(tl ORDER BY tl), list(term ORDER BY tl)) AS names FROM best GROUP BY 1, 2),
    cuts AS (SELECT v.chapter_id, v.ord, coalesce(v.zh_hans, '') AS plain, pat, names,
                    regexp_extract_all(coalesce(v.zh_hans, ''), pat) AS hits, regexp_split_to_array(coalesce(v.zh_hans, ''), pat) AS gaps
             FROM verses v LEFT JOIN pats USING (chapter_id, ord))
    SELECT chapter_id, ord, CASE WHEN pat IS NULL THEN plain ELSE array_to_string(
             [gaps[i] || coalesce(hits[i] || '（' || map_extract(names, hits[i])[1] || '）', '') for i in range(1, len(gaps) + 1)], '') END AS annotated"""


@query("T4_annotate", S.query("edges terms", f"{ANNOTATED} FROM cuts"))
def _(s, d):
    return annotated(s, d).select("chapter_id", "ord", "annotated")


def annotated(s, d):
    terms = B.terms(s, d)
    tags = kept_edges(s, d).join(terms.select("slug", "term", "position"), "slug").select(
        "chapter_id", "ord", F.col("term").alias("tag"), F.col("position").alias("tag_no")
    )
    return T.annotate(verses(s, d), tags, terms, "zh_hans", ["chapter_id", "ord"])


@query("T4_annotate_all", S.query("edges terms", f"""{ANNOTATED},
      CASE WHEN pat IS NULL THEN 1 ELSE len(hits) + len([g for g in gaps if g <> '']) END::BIGINT AS n_segments FROM cuts"""))
def _(s, d):
    out = annotated(s, d)
    return out.select("chapter_id", "ord", "annotated", F.size("segments").alias("n_segments"))


@query("F2_glossary_filter", S.query("terms", """
    SELECT slug FROM terms WHERE category = 'name' AND contains(lower(concat_ws(' ', nullif(term, ''), nullif(ja, ''), nullif(source_def, ''), nullif(note_ja, ''))), 'an')"""))
def _(s, d):
    return T.glossary_filter(B.terms(s, d), " AN ", "name", "ja").select("slug")


@query("F5_locked_terms", S.query("stored", "SELECT slug FROM stored WHERE hant <> '' OR hans <> '' OR ja <> ''"))
def _(s, d):
    return T.locked_terms(B.stored_terms(s, d)).select("slug")


@query("F6_fully_rendered", S.query("stored", """
    SELECT slug, coalesce(hant <> '' AND hans <> '' AND ja <> '', false) AS locked FROM stored"""))
def _(s, d):
    return B.stored_terms(s, d).select("slug", T.fully_rendered().alias("locked"))


@query("O2_glossary_sort", S.query("terms", "SELECT slug, term, row_number() OVER (ORDER BY lower(term), term, slug) AS n FROM terms"))
def _(s, d):
    from lectern.operators.ordered import number_sorted

    numbered = number_sorted(B.terms(s, d), [], [F.lower("term"), F.col("term"), F.col("slug")], "n")
    return T.glossary_sort(numbered).select("slug", "term", "n")


# --- search ---------------------------------------------------------------------------


def search_queries(s, d):
    """Every dictionary headword, asked as a query (a reverse search of the glossary)."""
    return Q.term_queries(B.terms(s, d))


def hits(s, d):
    """Only words that are asked for leave their verse."""
    keys, asked = ["chapter_id", "chapter", "ord"], search_queries(s, d)
    return Q.search(Q.build_index(verses(s, d), "en", keys, only=Q.query_tokens(asked)), asked, keys)


INDEX = f"""
    idx AS (SELECT chapter_id, chapter, ord, token, count(*) AS tf FROM (
        SELECT chapter_id, chapter, ord, unnest({S.tokens('en')}) AS token FROM verses) GROUP BY ALL),
    q AS (SELECT DISTINCT slug AS query_id, unnest(string_split(term, ' ')) AS token FROM terms),
    qk AS (SELECT query_id, count(*) AS k FROM q GROUP BY 1),
    df AS (SELECT token, count(*) AS df FROM idx GROUP BY 1),
    found AS (SELECT query_id, chapter_id, chapter, ord, round(sum(tf * ln(1 + 1.0 / df)), 6) AS score
        FROM q JOIN idx USING (token) JOIN df USING (token) GROUP BY 1, 2, 3, 4
        HAVING count(*) = (SELECT k FROM qk WHERE qk.query_id = q.query_id))"""


@query("T6_inverted_index", S.query("verses", f""", {INDEX.split('q AS')[0].strip().rstrip(',')}
    SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM idx GROUP BY 1"""))
def _(s, d):
    index = Q.build_index(verses(s, d), "en", ["chapter_id", "ord"])
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("T6_search_verses", S.query("verses terms", f", {INDEX} SELECT query_id, chapter_id, chapter, ord, score FROM found"))
def _(s, d):
    return hits(s, d)


@query("T6_search_context", S.query("verses terms", f""", {INDEX}
    SELECT query_id, chapter_id, ord, en AS text, previous, following FROM found JOIN (
      SELECT chapter_id, ord, en, lag(en) OVER w AS previous, lead(en) OVER w AS following FROM verses
      WINDOW w AS (PARTITION BY chapter_id ORDER BY ord)) USING (chapter_id, ord)"""))
def _(s, d):
    context = C.verses_of(B.chapters(s, d), context=True).select(
        "chapter_id", "ord", F.col("en").alias("text"), "previous", "following"
    )
    return hits(s, d).join(context, ["chapter_id", "ord"]).select(
        "query_id", "chapter_id", "ord", "text", "previous", "following"
    )


def stored_index(s, d):
    """(postings, blocks) of the words asked for, from an index written to the shared folder."""
    root = f"{shared_folder(s)}/index-{uuid.uuid4().hex}"
    Q.write_index(Q.build_index(verses(s, d), "en", ["chapter_id", "chapter", "ord"]), root)
    return Q.read_index(s, root, Q.query_tokens(search_queries(s, d)))


@query("T6_stored_search", S.query("verses terms", f", {INDEX} SELECT query_id, chapter_id, chapter, ord, score FROM found"))
def _(s, d):
    postings, blocks = stored_index(s, d)
    return Q.search(postings.drop("block"), search_queries(s, d), ["chapter_id", "chapter", "ord"], frequency=Q.frequencies(blocks))


@query("T6_stored_top_hits", S.query("verses terms", f""", {INDEX}
    SELECT query_id, chapter_id, ord, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chapter, ord) AS rank FROM found) WHERE rank <= 8"""))
def _(s, d):
    return Q.top_hits(*stored_index(s, d), search_queries(s, d)).select(
        "query_id", "chapter_id", "ord", "score", F.col("rank").cast("bigint").alias("rank"))


# Character pairs of the two or three signs that a translated line starts with.
SIGNS = {"zh_hant": ("譯", "譯文本"), "zh_hans": ("译", "译文"), "ja": ("ア", "アイ")}


def _pairs_sql(lang: str) -> str:
    sign, signs = SIGNS[lang]
    pairs = ", ".join(f"'{signs[i:i + 2]}'" for i in range(len(signs) - 1))
    other = ", 'ア'" if lang == "zh_hant" else ""
    held = f"CASE WHEN contains({lang}, '{sign}') THEN [{pairs}] WHEN contains({lang}, 'ア') THEN ['ア'] ELSE [] END" if other else (
        f"CASE WHEN contains({lang}, '{sign}') THEN [{pairs}] ELSE [] END")
    return f"SELECT DISTINCT '{lang}', chapter_id, ord, unnest(list_concat({S.tokens(lang)}, {held})) AS token FROM verses"


@query("T7_search_by_language", S.query("verses", f"""
    SELECT lang, token, count(*) AS df FROM (
      SELECT DISTINCT 'en' AS lang, chapter_id, ord, unnest({S.tokens('en')}) AS token FROM verses
      UNION {_pairs_sql('zh_hant')} UNION {_pairs_sql('zh_hans')} UNION {_pairs_sql('ja')})
    GROUP BY 1, 2"""))
def _(s, d):
    longer = verses(s, d).select("chapter_id", "ord", "en", *[F.replace(x, F.lit(a), F.lit(b)).alias(x) for x, (a, b) in SIGNS.items()])
    index = Q.index_by_language(longer, ["chapter_id", "ord"])
    return index.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("df"))


@query("T8_snippet", S.query("verses terms", """
    SELECT chapter_id, ord, CASE WHEN p > 0 THEN CASE WHEN st > 1 THEN '…' ELSE '' END || substr(en, st, p - st) || '<mark>' || substr(en, p, n) || '</mark>'
           || substr(en, p + n, 60) || CASE WHEN p + n + 60 <= len(en) THEN '…' ELSE '' END ELSE '' END AS excerpt
    FROM (SELECT *, len(w) AS n, instr(lower(en), w) AS p, greatest(instr(lower(en), w) - 30, 1) AS st
          FROM (SELECT v.*, string_split(t.term, ' ')[2] AS w FROM verses v JOIN terms t ON t.slug = v.tag))"""))
def _(s, d):
    words = B.terms(s, d).select("slug", F.element_at(F.split("term", " "), 2).alias("w"))
    rows = verses(s, d).select("chapter_id", "ord", "en", F.explode("glossary_terms").alias("slug")).join(words, "slug")
    return rows.select("chapter_id", "ord", Q.snippet(F.col("en"), F.col("w")).alias("excerpt"))


@query("T9_reverse_search", S.query("verses terms", f""", {INDEX}
    SELECT slug AS query_id, coalesce(n, 0) AS n_hits, (coalesce(n, 0) + 9) // 10 AS n_pages
    FROM terms LEFT JOIN (SELECT query_id, count(*) AS n FROM found GROUP BY 1) f ON f.query_id = slug"""))
def _(s, d):
    n = hits(s, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return search_queries(s, d).select("query_id").join(n, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("n_hits"), Q.page_count(F.coalesce("n", F.lit(0))).alias("n_pages")
    )


@query("W10_page_number", S.query("verses terms", f""", {INDEX}
    SELECT query_id, chapter_id, ord, rank, (rank - 1) // 10 AS page FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chapter, ord) AS rank FROM found)"""))
def _(s, d):
    return Q.number_hits(hits(s, d)).select("query_id", "chapter_id", "ord", "rank", Q.page_of(F.col("rank")).alias("page"))


TOP = "SELECT chapter_id, chapter, ord, max(score) AS score FROM found GROUP BY 1, 2, 3 ORDER BY score DESC, chapter, ord"


def best(s, d):
    return hits(s, d).groupBy("chapter_id", "chapter", "ord").agg(F.max("score").alias("score"))


@query("O4_top_k_hits", S.query("verses terms", f", {INDEX} SELECT chapter_id, ord, score FROM ({TOP} LIMIT 8)"))
def _(s, d):
    return Q.top_k(best(s, d)).select("chapter_id", "ord", "score")


@query("O5_paged_slice", S.query("verses terms", f", {INDEX} SELECT chapter_id, ord, score FROM ({TOP} LIMIT 10 OFFSET 20)"))
def _(s, d):
    return Q.page_slice(best(s, d), 2).select("chapter_id", "ord", "score")


@query("O6_longest_first", S.query("edges terms", """
    SELECT chapter_id, ord, string_agg(zh_hans, ',' ORDER BY len(zh_hans) DESC, position) AS renderings
    FROM edges JOIN terms USING (slug) GROUP BY 1, 2"""))
def _(s, d):
    t = B.terms(s, d).select("slug", "position", F.col("translit.zh_hans").alias("r"))
    pairs = F.array_sort(F.collect_list(F.struct((-F.length("r")).alias("n"), "position", "r")))
    return edges(s, d).join(t, "slug").groupBy("chapter_id", "ord").agg(
        F.array_join(F.transform(pairs, lambda p: p["r"]), ",").alias("renderings")
    )
