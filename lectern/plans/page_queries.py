"""HTML, segmentation, chapter files, rendered pages, event state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.operators import segment as G
from lectern.plans import binding as B
from lectern.plans import sql as S
from lectern.plans.registry import query
from lectern.plans.term_queries import RENDERED, rendered_terms
from lectern.session import shared_folder
from lectern.sources import files as FS
from lectern.sources import html as H
from lectern.sources import pages as P
from lectern.streaming import events as E


def pages(s, d):
    return B.table(s, d, "pages")


@query("S4_shred_html")
def _(s, d):
    e = H.shred_html(pages(s, d))
    return e.select("page_id", "pos", "tag", "name", "src", X.sha16(F.col("text")).alias("text_sha"), "last")


@query("S4_element_counts", """
    SELECT page_id, tag, count(*) AS n FROM (
      SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<(a|p|img|h1|h2|h3|blockquote|dt|dd|b)[ />]', 1)) AS tag FROM pages)
    GROUP BY 1, 2""")
def _(s, d):
    return H.shred_html(pages(s, d)).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("S4_flat_elements", S.query("flat", r"""
    SELECT page_id, pos, lower(regexp_extract(cut, '^<([a-zA-Z0-9]+)', 1)) AS tag,
           nullif(regexp_extract(cut, '(?:src|href)="([^"]*)"', 1), '') AS src, regexp_extract(cut, '(?s)>([^<]*)$', 1) AS text FROM flat"""))
def _(s, d):
    return H.flat_elements(pages(s, d)).drop("name")


@query("S5_cache_inventory", """
    SELECT page_id, TRY_CAST(regexp_extract(name, '^pg(\\d+)\\.htm$', 1) AS BIGINT) AS number FROM (
      SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'index' || page_id || '.htm' ELSE 'pg' || page_id || '.htm' END AS name FROM pages)
    WHERE regexp_matches(name, '^pg(\\d+)\\.htm$')""")
def _(s, d):
    name = F.concat(F.when(F.col("page_id") % 5 == 0, "index").otherwise("pg"), F.col("page_id").cast("string"), F.lit(".htm"))
    return FS.inventory_numbers(pages(s, d).select("page_id", name.alias("name")), "name", r"^pg(\d+)\.htm$").select("page_id", "number")


@query("S6_worklist", S.query("ranges", """
    SELECT n AS number, CASE WHEN n < 10 THEN 'pg0' ELSE 'pg' END || n || '.htm' AS name, slug, n - lo + 1 AS ordinal
    FROM (SELECT unnest(range(2, (SELECT max(doc_id) + 1 FROM documents))) AS n) JOIN ranges ON n BETWEEN lo AND hi"""))
def _(s, d):
    from lectern.operators.joins import assign_ranges

    # The key range grows with the table; its upper end is one row.
    top = B.table(s, d, "documents").agg(F.max("doc_id").alias("m")).head().m
    todo = FS.worklist(s, 2, top, "pg%02d.htm")
    return assign_ranges(todo, "number", B.ranges(s, d)).where("slug is not null").select("number", "name", "slug", "ordinal")


@query("S7_incremental_skip", """
    SELECT d.doc_id, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS skipped FROM documents d ANTI JOIN labels USING (doc_id)""")
def _(s, d):
    docs, done = B.table(s, d, "documents").select("doc_id"), B.table(s, d, "labels")
    skipped = FS.skipped_count(docs, done, ["doc_id"])
    return FS.skip_existing(docs, done, ["doc_id"]).select("doc_id", skipped.scalar().alias("skipped"))


@query("S7_two_outputs", """
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0)""")
def _(s, d):
    labels = B.table(s, d, "labels")
    full, thumb = labels, labels.where("doc_id % 3 <> 0")
    both = FS.complete_pairs(full, thumb, ["doc_id"])
    return FS.skip_existing(B.table(s, d, "documents").select("doc_id"), both, ["doc_id"])


@query("S7_translated_books", S.query("verses", "SELECT book, count(DISTINCT chapter_id) AS n FROM verses WHERE zh_hant IS NULL AND book NOT IN (SELECT book FROM verses WHERE zh_hant IS NOT NULL) GROUP BY 1"))
def _(s, d):
    ch = B.chapters(s, d)
    todo = FS.skip_existing(ch, FS.translated_books(ch), ["book"])
    return todo.groupBy("book").agg(F.count(F.lit(1)).alias("n"))


@query("S8_chapter_json", S.query("verses heads", """
    SELECT h.book || '/chapter-' || CASE WHEN chapter < 10 THEN '0' ELSE '' END || chapter || '.json' AS file, chapter_id AS id, n AS n_verses, images AS n_images, en AS first_en
    FROM heads h JOIN (SELECT chapter_id, count(*) AS n, sum(n_images)::BIGINT AS images, arg_min(en, ord) AS en FROM verses GROUP BY 1) USING (chapter_id)"""))
def _(s, d):
    from lectern import schemas

    # Written and read back through the declared schema.
    text = FS.chapter_json(B.chapters(s, d))
    back = text.select("file", F.from_json("json", schemas.CHAPTER).alias("c"))
    return back.select(
        "file", "c.id", F.size("c.verses").alias("n_verses"),
        F.aggregate("c.verses", F.lit(0), lambda n, v: n + F.coalesce(F.size(v["images"]), F.lit(0))).alias("n_images"),
        F.get("c.verses", F.lit(0))["en"].alias("first_en"),
    )


@query("S8_nest_verses", S.query("verses", "SELECT chapter_id AS id, count(*) AS n, string_agg(verse_id, ',' ORDER BY ord) AS ids FROM verses GROUP BY 1"))
def _(s, d):
    ch = B.chapters(s, d)
    nested = C.nest_verses(C.verses_of(ch), ch.drop("verses"))
    return nested.select("id", F.size("verses").alias("n"), F.array_join(F.transform("verses", lambda v: v["id"]), ",").alias("ids"))


# The page of a chapter, letter by letter: front matter, the chapter as JSON, its dictionary slice.
JSON = "coalesce(to_json({})::VARCHAR, 'null')"
TEXT_JSON = lambda *texts: "'{\"en\":' || " + " || ',\"".join(
    f"{name}\":' || {JSON.format(t)}" if i else JSON.format(t) for i, (name, t) in enumerate(zip(("en", *X.LANGS), texts))) + " || '}'"
CAPTION = TEXT_JSON("'Plate ' || (d % 50) || ' ' || en", "CASE WHEN d % 2 = 0 THEN '圖' || lower(en) END", "CASE WHEN d % 3 = 0 THEN en END", "NULL")
PAGE_SQL = f"""
    , pos AS (SELECT source AS book, coalesce(b.title, upper(source[1]) || source[2:]) AS book_title, row_number() OVER (ORDER BY position NULLS LAST, source) AS position
              FROM (SELECT DISTINCT source FROM documents) LEFT JOIN books b ON slug = source),
    sizes AS (SELECT book, count(*) AS n FROM heads GROUP BY 1),
    vjson AS (SELECT chapter_id, string_agg('{{"id":' || {JSON.format('verse_id')} || ',"verse_number":' || verse_number || ',"en":' || {JSON.format('en')}
        || ',"zh_hant":' || {JSON.format('zh_hant')} || ',"zh_hans":' || {JSON.format('zh_hans')} || ',"ja":' || {JSON.format('ja')}
        || ',"glossary_terms":[' || coalesce(to_json(tag)::VARCHAR, '') || '],"plate_ref":null,"notes":[],"images":'
        || CASE WHEN n_images = 0 THEN 'null' ELSE '[{{"src":"/plates/image' || (d % 50) || '.jpg","edition":"1","caption":' || {CAPTION} || '}}'
           || CASE WHEN n_images = 2 THEN ',{{"src":"/plates/sign' || o || '.gif","edition":"1","caption":null}}' ELSE '' END || ']' END || '}}', ',' ORDER BY ord) AS verses
      FROM verses GROUP BY 1),
    pre AS (SELECT chapter_id, {TEXT_JSON("'Epigraph ' || en", "CASE WHEN d % 6 = 0 THEN '序' || lower(en) END", "CASE WHEN d % 5 = 0 THEN en END", "NULL")} AS preamble
            FROM verses WHERE o = 1),
    slices AS (SELECT chapter_id, '{{' || string_agg(to_json(term)::VARCHAR || ':{{"translit":{{"zh_hant":' || to_json(zh_hant) || ',"zh_hans":' || to_json(zh_hans)
        || CASE WHEN ja IS NOT NULL THEN ',"ja":' || to_json(ja) ELSE '' END || '}},"slug":"' || slug || '"}}', ',' ORDER BY term) || '}}' AS glossary
      FROM rendered JOIN terms USING (slug) GROUP BY 1)
    SELECT h.book, h.book || CASE WHEN n > 1 THEN '/' || CASE WHEN chapter < 10 THEN '0' ELSE '' END || chapter ELSE '' END AS path, {S.sha16(
      "'---' || chr(10) || CASE WHEN n > 1 THEN 'id: ' || chapter_id || chr(10) || 'title: \"' || title || '\"' || chr(10) || 'sidebar_label: \"Chapter ' || chapter || '\"' || chr(10) || 'sidebar_position: ' || chapter"
      " ELSE 'id: ' || h.book || chr(10) || 'title: \"' || book_title || '\"' || chr(10) || 'sidebar_label: \"' || book_title || '\"' || chr(10) || 'sidebar_position: ' || position END || chr(10) || '---' || chr(10)"
      " || chr(10) || 'chapter: {\"id\":\"' || chapter_id || '\",\"book\":\"' || h.book || '\",\"chapter\":' || chapter || ',\"title\":' || to_json(title) || ',\"preamble\":' || preamble"
      " || ',\"preamble_source\":' || coalesce(to_json(preamble_source)::VARCHAR, 'null') || ',\"verses\":[' || verses || ']}' || chr(10) || 'glossary: ' || coalesce(glossary, '{}')"
      " || CASE WHEN n > 1 AND chapter = 1 THEN chr(10) || 'hidePreamble: true' || chr(10) ELSE chr(10) END")} AS body_sha
    FROM heads h JOIN pos USING (book) JOIN sizes USING (book) JOIN vjson USING (chapter_id) JOIN pre USING (chapter_id) LEFT JOIN slices USING (chapter_id)"""


@query("S10_render_pages", S.query("heads books records terms", f", {RENDERED} {PAGE_SQL}"))
def _(s, d):
    ch, terms = B.rich_chapters(s, d), B.terms(s, d)
    slices = P.slice_maps(rendered_terms(s, d), terms)
    out = P.render_chapters(ch, C.number_books(ch, B.books(s, d)), slices)
    return out.select("book", "path", X.sha16(F.col("body")).alias("body_sha"))


@query("S11_book_indexes", S.query("heads books", """
    , pos AS (SELECT source AS book, coalesce(b.title, upper(source[1]) || source[2:]) AS title, row_number() OVER (ORDER BY position NULLS LAST, source) AS position
                   FROM (SELECT DISTINCT source FROM documents) LEFT JOIN books b ON slug = source),
    n AS (SELECT *, (row_number() OVER (PARTITION BY book ORDER BY chapter) - 1) // 1000 AS part_no FROM heads),
    intro AS (SELECT book, arg_min(coalesce(pre_en, ''), chapter) AS pre FROM heads GROUP BY 1)
    SELECT book, book || '/index' || CASE WHEN part_no > 0 THEN '-' || part_no ELSE '' END AS path, part_no, CASE WHEN part_no = 0 THEN
      '---' || chr(10) || 'id: ' || book || chr(10) || 'title: "' || any_value(p.title) || '"' || chr(10) || 'sidebar_label: "' || any_value(p.title) || '"' || chr(10) || 'sidebar_position: ' || any_value(position) || chr(10) || '---' || chr(10)
      || chr(10) || '# ' || any_value(p.title) || chr(10) || CASE WHEN any_value(pre) <> '' THEN chr(10) || '> ' || any_value(pre) || chr(10) ELSE '' END || chr(10) ELSE '' END
      || string_agg('- [Chapter ' || chapter || '](/' || book || '/' || chapter_id || ')', chr(10) ORDER BY chapter) || chr(10) AS body
    FROM n JOIN pos p USING (book) JOIN intro USING (book) GROUP BY book, part_no"""))
def _(s, d):
    ch = B.chapters(s, d)
    filled = ch.withColumn("preamble", F.struct(F.coalesce("preamble.en", F.lit("")).alias("en")))
    return P.book_indexes(filled, C.number_books(ch, B.books(s, d)))


@query("S11_top_index", S.query("books", """
    SELECT 0::BIGINT AS line_no, '# All' AS line UNION ALL
    SELECT row_number() OVER (ORDER BY position), '- [' || coalesce(title, upper(slug[1]) || slug[2:]) || '](./' || slug || '/)' FROM books"""))
def _(s, d):
    ch, books = B.chapters(s, d), B.books(s, d)
    numbered = C.number_books(ch, books)
    return P.top_index(numbered, books, "All").unionByName(P.placeholder(numbered))


VERSIONS = f"""
    r AS (SELECT CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS book, 'terms' || chr(1) || slug AS k,
                 {S.sha16("'{\"zh_hant\":' || to_json(zh_hant) || ',\"zh_hans\":' || to_json(zh_hans) || ',\"ja\":' || coalesce(to_json(ja)::VARCHAR, 'null') || '}'")} AS x FROM terms),
    l4 AS (SELECT book, left({S.sha16('k')}, 4) AS b, {S.sha16("string_agg(k || '=' || x, chr(10) ORDER BY k)")} AS x FROM r GROUP BY 1, 2),
    l2 AS (SELECT book, left(b, 2) AS b2, {S.sha16("string_agg(b || '=' || x, chr(10) ORDER BY b)")} AS x FROM l4 GROUP BY 1, 2),
    versions AS (SELECT book, {S.sha16("string_agg(b2 || '=' || x, chr(10) ORDER BY b2)")} AS version FROM l2 GROUP BY 1)"""


@query("S13_S14_snapshot", S.query("terms", f""", {VERSIONS}
    SELECT book, version, count(*) AS n, count(DISTINCT slug) AS slugs, TRUE AS stale_refused
    FROM (SELECT *, CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS book FROM terms) JOIN versions USING (book) GROUP BY 1, 2"""))
def _(s, d):
    # Published, read back through the pointer; a second writer from the same base is refused.
    root = f"{shared_folder(s)}/snapshots-{uuid.uuid4().hex}"
    parts = B.terms(s, d).select(
        F.when(F.col("position") % 2 == 0, "even").otherwise("odd").alias("book"), F.lit("terms").alias("part"), "slug",
        F.to_json("translit", {"ignoreNullFields": "false"}).alias("payload"),
    )
    FS.publish_snapshot(parts, root, base=0)
    try:
        FS.publish_snapshot(parts.withColumn("payload", F.lit("late")), root, base=0)
        refused = False
    except FS.StaleSnapshot:
        refused = True
    return FS.read_snapshot(s, root).groupBy("book", "version").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("slug").alias("slugs")
    ).withColumn("stale_refused", F.lit(refused))


@query("S9_write_runs", """
    SELECT 1::BIGINT AS run, source AS book FROM documents GROUP BY source
    UNION ALL SELECT 3, source FROM documents WHERE doc_id % 200 = 7 GROUP BY source
    UNION ALL SELECT 4, 'written: ' || count(*) FROM documents""")
def _(s, d):
    # Written, written again unchanged, then with a few chapters edited: the books each run wrote, and what lies there.
    root = f"{shared_folder(s)}/books-{uuid.uuid4().hex}"
    ch = B.chapters(s, d)
    edited = ch.withColumn("title", F.when(F.col("chapter") % 200 == 7, "edited").otherwise(F.col("title")))
    runs = [FS.write_changed_books(content, root).select(F.lit(n).cast("bigint").alias("run"), "book") for n, content in enumerate((ch, ch, edited), 1)]
    held = FS.read_written_chapters(s, f"{root}/books").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(4).cast("bigint").alias("run"), F.concat(F.lit("written: "), "n").alias("book"))
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(held)


@query("S9_second_run", "SELECT 0::BIGINT AS changed")
def _(s, d):
    # A second run over unchanged chapters writes no book.
    root = f"{shared_folder(s)}/books-{uuid.uuid4().hex}"
    FS.write_changed_books(B.chapters(s, d), root)
    return FS.write_changed_books(B.chapters(s, d), root).agg(F.count(F.lit(1)).alias("changed"))


# --- segmentation ---------------------------------------------------------------------


def rows(s, d):
    return G.standard_rows(B.elements(s, d), B.anchors(s, d))


@query("W1_carry_forward", S.query("placed", """
    SELECT page_id, pos, coalesce(seg, -1) AS seg, CASE WHEN seg_kind <> 'gallery' THEN source END AS slug, chap AS chapter FROM placed"""))
def _(s, d):
    ctx = G.with_context(B.elements(s, d), B.anchors(s, d))
    return ctx.select("page_id", "pos", F.coalesce("ctx.seg", F.lit(-1)).alias("seg"), "ctx.slug", "ctx.chapter")


FLAT = r"trim(regexp_replace({}, '[\s\x{{00A0}}]+', ' ', 'g'))"


@query("W2_preamble_split", S.query("roles", f"""
    SELECT page_id, seg, string_agg({FLAT.format("CASE WHEN m = 4 THEN line ELSE pos || '. ' || line END")}, ' ' ORDER BY pos) AS preamble
    FROM roles WHERE role = 'preamble' GROUP BY 1, 2"""))
def _(s, d):
    pre = rows(s, d).where("role = 'preamble'")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"])
    return pre.groupBy("page_id", "seg").agg(X.collapse(F.array_join(joined, " ")).alias("preamble"))


@query("A10_join_preamble", S.query("roles", f"""
    SELECT page_id, seg, count(*) AS n_parts, {S.sha16(FLAT.format("string_agg(CASE WHEN m = 4 THEN line ELSE pos || '. ' || line END, ' ' ORDER BY pos)"))} AS sha
    FROM roles WHERE role = 'preamble' GROUP BY 1, 2"""))
def _(s, d):
    pre = rows(s, d).where("role = 'preamble'")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"])
    return pre.groupBy("page_id", "seg").agg(
        F.count(F.lit(1)).alias("n_parts"), X.sha16(X.collapse(F.array_join(joined, " "))).alias("sha")
    )


@query("W3_W4_attach_images", S.query("roles", """
    SELECT page_id, pos, src, target_seg, target_pos FROM roles WHERE role = 'image' AND target_seg IS NOT NULL"""))
def _(s, d):
    return rows(s, d).where("role = 'image'").select("page_id", "pos", "src", "target_seg", "target_pos")


# Sections: anchors <source>_<k>; the gallery anchor ends only the last section.
SECTIONS = r"""
    s0 AS (SELECT *, CASE WHEN anchor = 'chapter' THEN pos END AS st, CASE WHEN anchor IN ('title', 'gallery') THEN pos END AS sp FROM elements),
    s1 AS (SELECT *, last_value(st IGNORE NULLS) OVER b AS seg2, last_value(sp IGNORE NULLS) OVER b AS stop, first_value(st IGNORE NULLS) OVER a AS nxt FROM s0
           WINDOW b AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  a AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    s2 AS (SELECT *, tag = 'p' AND m NOT IN (3, 4) AND trim(regexp_replace(line, '[\s\x{00A0}]+', ' ', 'g')) <> '' AS v FROM s1
           WHERE seg2 IS NOT NULL AND NOT (nxt IS NULL AND coalesce(stop > seg2, FALSE))),
    s3 AS (SELECT *, max(CASE WHEN v THEN pos END) OVER (PARTITION BY page_id, seg2) AS last_v,
                  first_value(CASE WHEN v THEN pos END IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v THEN seg2 END IGNORE NULLS) OVER a AS ns FROM s2
           WINDOW a AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    s4 AS (SELECT page_id, seg2, dense_rank() OVER (PARTITION BY page_id ORDER BY seg2) AS chapter FROM s2 WHERE v)"""


@query("W5_dense_sections", S.query("elements", f""", {SECTIONS},
    s5 AS (SELECT DISTINCT page_id, seg2, chapter FROM s4)
    SELECT x.page_id, x.pos, x.role, x.target_pos, s5.chapter FROM (
      SELECT page_id, pos, 'verse' AS role, seg2 AS tseg, pos AS target_pos FROM s3 WHERE v
      UNION ALL SELECT page_id, pos, 'image', CASE WHEN ns = seg2 OR last_v IS NULL OR last_v > pos THEN ns ELSE seg2 END,
                       CASE WHEN ns = seg2 OR last_v IS NULL THEN nv ELSE last_v END FROM s3 WHERE tag = 'img') x
    JOIN s5 ON s5.page_id = x.page_id AND s5.seg2 = x.tseg"""))
def _(s, d):
    # Section books name their prefix; every source is read as such a book here.
    out = G.section_rows(B.elements(s, d, "source"), F.concat("source", F.lit("_")), F.col("source"))
    return out.where("role <> 'preamble'").select("page_id", "pos", "role", "target_pos", "chapter")


@query("W6_implicit_numbering", S.query("v0", """
    , n AS (SELECT *, CASE WHEN d % 2 = 0 AND o % 5 <> 1 THEN o || '. ' || en ELSE en END AS t FROM v0 WHERE en <> ''),
    f AS (SELECT *, min(CASE WHEN regexp_matches(t, '(?s)^([0-9]+)\\.\\s+(.*)') THEN o END) OVER (PARTITION BY d) AS first FROM n)
    SELECT d AS page_id, o AS pos, CASE WHEN first IS NULL THEN row_number() OVER (PARTITION BY d, first IS NULL ORDER BY o)
      WHEN regexp_matches(t, '(?s)^([0-9]+)\\.\\s+(.*)') THEN regexp_extract(t, '^([0-9]+)', 1)::BIGINT END AS number,
      CASE WHEN first IS NULL OR regexp_matches(t, '(?s)^([0-9]+)\\.\\s+(.*)') THEN 'verse' ELSE 'preamble' END AS role
    FROM f WHERE first IS NULL OR regexp_matches(t, '(?s)^([0-9]+)\\.\\s+(.*)') OR o < first"""))
def _(s, d):
    docs = B.table(s, d, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.posexplode(F.split("text", "\n")).alias("i", "en")
    ).withColumn("pos", (F.col("i") + 1).cast("bigint")).where("en <> ''")
    numbered = (F.col("page_id") % 2 == 0) & (F.col("pos") % 5 != 1)
    text = F.when(numbered, F.concat(F.col("pos").cast("string"), F.lit(". "), "en")).otherwise(F.col("en"))
    return G.page_paragraphs(docs.withColumn("text", text)).select("page_id", "pos", "number", "role")


@query("W7_last_wins", S.query("marked", """
    SELECT page_id, 1 + (chap - 1) % 3 AS chapter, max(seg) AS seg FROM marked WHERE is_verse GROUP BY 1, 2"""))
def _(s, d):
    # Chapter numbers repeat after three here, so later segments replace earlier ones.
    e = B.elements(s, d)
    k = F.regexp_extract("name", r"_(\d+)$", 1).cast("bigint")
    again = F.concat(F.regexp_extract("name", r"^(.*_)\d+$", 1), (1 + (k - 1) % 3).cast("string"))
    e = e.withColumn("name", F.when(F.col("name").rlike(r"^src\d+_\d+$"), again).otherwise(F.col("name")))
    return G.last_segments(G.standard_rows(e, B.anchors(s, d))).select("page_id", "chapter", "seg")


@query("W_assembled_chapters", S.query("roles", """
    , w AS (SELECT page_id, source, chap, max(seg) AS seg FROM roles WHERE role = 'verse' GROUP BY 1, 2, 3)
    SELECT w.page_id, w.source || '.' || w.chap AS id, count(*) FILTER (role = 'verse') AS n_verses, count(*) FILTER (role = 'image') AS n_images
    FROM w JOIN roles r ON r.page_id = w.page_id AND r.target_seg = w.seg AND r.role IS NOT NULL GROUP BY 1, 2"""))
def _(s, d):
    out = G.assemble_chapters(rows(s, d))
    return out.select("page_id", "id", F.size("verses").alias("n_verses"), C.image_count().alias("n_images"))


SQUEEZED = r"trim(regexp_replace({}, '[\s\x{{00A0}}]+', ' ', 'g'))"


@query("T5_extract_glossary", S.query("v0", f"""
    , w AS (SELECT d, o, en, regexp_extract(en, '^[^ ]*', 0) AS w FROM v0),
    e AS (SELECT d, o, 1 AS strategy, term, trim(regexp_replace(substr({SQUEEZED.format('en')}, len(term) + 1), '^[ .—–:-]+', '')) AS definition
          FROM (SELECT *, regexp_replace({SQUEEZED.format('w')}, '[.,:;]+$', '') AS term FROM w) WHERE o % 2 = 1
          UNION ALL SELECT d, o, 2, regexp_replace({SQUEEZED.format('w')}, '[.,:;]+$', ''), {SQUEEZED.format('substr(en, len(w) + 1)')} FROM w WHERE o % 2 = 0),
    k AS (SELECT *, regexp_replace(regexp_replace(lower(term), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM e
          WHERE len(term) > 0 AND len(term) < 80 AND (strategy = 2 OR definition <> ''))
    SELECT slug, term, {S.sha16('definition')} AS definition_sha, d AS page_id FROM k
    QUALIFY row_number() OVER (PARTITION BY slug ORDER BY strategy, d, o) = 1"""))
def _(s, d):
    # Documents written as glossary pages: bold paragraphs on odd lines, dt / dd on even.
    def entry(line, i):
        safe = F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        word = F.regexp_extract(safe, "^[^ ]*", 0)
        rest = F.substring(safe, F.length(word) + 1, F.length(safe))
        bold = F.concat(F.lit("<p><b>"), word, F.lit("</b>"), rest, F.lit("</p>"))
        listed = F.concat(F.lit("<dl><dt>"), word, F.lit("</dt><dd>"), rest, F.lit("</dd></dl>"))
        return F.when(i % 2 == 0, bold).otherwise(listed)

    html = F.array_join(F.transform(F.split("text", "\n"), entry), "\n")
    docs = B.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return H.headwords(H.shred_html(docs)).select("slug", "term", X.sha16(F.col("definition")).alias("definition_sha"), "page_id")


@query("X4_union_strategies", S.query("v0", """
    , e AS (SELECT CASE WHEN o % 2 = 0 THEN 1 ELSE 2 END AS strategy, d AS page_id, o AS pos, string_split(en, ' ')[1] AS term FROM v0),
    k AS (SELECT *, regexp_replace(regexp_replace(lower(term), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM e)
    SELECT slug, strategy::BIGINT AS strategy, page_id, pos, term FROM k QUALIFY row_number() OVER (PARTITION BY slug ORDER BY strategy, page_id, pos) = 1"""))
def _(s, d):
    v = C.verses_of(B.chapters(s, d)).select(
        F.when(F.col("ord") % 2 == 0, 1).otherwise(2).alias("strategy"), F.col("chapter").alias("page_id"),
        F.col("ord").alias("pos"), F.get(F.split("en", " "), F.lit(0)).alias("term"),
    )
    return H.union_strategies(v.where("strategy = 1"), v.where("strategy = 2"))


@query("W_epigraphs", S.query("v0", r"""
    , n AS (SELECT d, o, trim(regexp_replace(CASE WHEN o % 8 = 4 THEN o || '. ' || en WHEN o % 8 = 1 THEN 'p. ' || o WHEN o % 8 = 2 THEN 'Chapter ' || o ELSE en END, '[\s\x{00A0}]+', ' ', 'g')) AS t FROM v0),
    f AS (SELECT *, min(CASE WHEN regexp_matches(t, '^[0-9]+\.\s') THEN o END) OVER (PARTITION BY d) AS first FROM n WHERE t <> '')
    SELECT doc_id AS page_id, coalesce(string_agg(t, ' ' ORDER BY o), '') AS epigraph FROM documents LEFT JOIN f
      ON d = doc_id AND (first IS NULL OR o < first) AND NOT regexp_matches(t, '(?i)^p\.\s+\S+$') AND NOT regexp_matches(t, '(?i)^chapter\s+[0-9]+') AND NOT regexp_matches(t, '(?i)example.com')
    GROUP BY 1"""))
def _(s, d):
    o = F.col("pos").cast("string")
    k = F.col("pos") % 8
    docs = B.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("i", "en"))
    docs = docs.withColumn("pos", F.col("i") + 1)
    text = F.when(k == 4, F.concat(o, F.lit(". "), "en")).when(k == 1, F.concat(F.lit("p. "), o)).when(
        k == 2, F.concat(F.lit("Chapter "), o)).otherwise(F.col("en"))
    return G.epigraphs(docs.select("page_id", "pos", text.alias("text")), "example.com")


# --- events ---------------------------------------------------------------------------


@query("R1_toggle_state", """
    SELECT user_id, event_type, count(*) % 2 = 1 AS bookmarked, count(*) AS flips, max(ts) AS last_ts FROM events GROUP BY 1, 2""")
def _(s, d):
    return E.toggle_state(B.clicks(s, d), ["user_id", "event_type"])


@query("R2_debounce", """
    SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
    WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 3600000000""")
def _(s, d):
    # Events here are minutes apart, so the quiet time is an hour instead of 300 ms.
    return E.debounce(B.clicks(s, d), ["user_id"], gap_ms=3_600_000, block_ms=86_400_000).select("event_id", "user_id")


@query("O3_recent_first", """
    SELECT user_id, event_type, last_ts FROM (SELECT user_id, event_type, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1, 2)
    WHERE n % 2 = 1 ORDER BY last_ts DESC, user_id""")
def _(s, d):
    return E.recent_first(E.bookmarks(B.clicks(s, d), ["user_id", "event_type"]), "last_ts", "user_id")
