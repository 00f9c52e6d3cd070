"""The derivations of ``binding.py`` as SQL common table expressions."""

from __future__ import annotations

TOKEN = "[a-z]+(?:[''-][a-z]+)*"


def norm(text: str) -> str:
    """NFC, apostrophes, lower case, ß as ss."""
    return (
        f"replace(lower(replace(replace(nfc_normalize({text}), '’', ''''), 'ʼ', '''')), 'ß', 'ss')"
    )


def tokens(text: str) -> str:
    return f"regexp_extract_all({norm(text)}, '{TOKEN}')"


def sha16(text: str) -> str:
    return f"left(sha256(coalesce({text}, '')), 16)"


CTES = {
    "v0": """
        SELECT d.source AS book, d.doc_id AS d, d.doc_id AS chapter,
               d.source || '.' || d.doc_id AS chapter_id, d.lang, d.text,
               unnest(string_split(d.text, chr(10))) AS en,
               generate_subscripts(string_split(d.text, chr(10)), 1)::BIGINT AS o
        FROM documents d""",
    "verses": """
        SELECT *, o AS ord, chapter_id || '.' || verse_number AS verse_id FROM (
        SELECT *,
               CASE WHEN d % 10 = 0 AND o = 3 THEN 2 WHEN d % 9 = 4 THEN o + 1 ELSE o END AS verse_number,
               CASE WHEN d % 4 = 0 THEN NULL WHEN d % 4 = 1 AND o % 2 = 0 THEN ''
                    WHEN d % 7 = 3 AND o % 4 = 0 THEN 'ア' || en ELSE '譯' || lower(en) END AS zh_hant,
               CASE WHEN d % 5 <> 0 THEN '译' || en END AS zh_hans,
               CASE WHEN o % 3 = 0 THEN '' WHEN o % 3 = 1 THEN NULL ELSE 'ア' || en END AS ja,
               CASE WHEN o % 5 = 0 THEN 't' || (d % 40) END AS tag,
               CASE WHEN o % 20 = 0 THEN 2 WHEN o % 10 = 0 THEN 1 ELSE 0 END AS n_images,
               CASE WHEN o % 10 = 0 THEN 'Plate ' || (d % 50) END AS cap_en,
               CASE WHEN o % 10 = 0 AND d % 2 = 0 THEN '圖' END AS cap_hant
        FROM v0)""",
    "heads": """
        SELECT source AS book, doc_id AS d, doc_id AS chapter, source || '.' || doc_id AS chapter_id,
               source || ' — Chapter ' || doc_id AS title, text,
               CASE WHEN doc_id % 3 = 0 THEN 'Epigraph ' || doc_id WHEN doc_id % 3 = 1 THEN NULL ELSE '' END AS pre_en,
               CASE WHEN doc_id % 6 = 0 THEN '序' END AS pre_hant,
               CASE WHEN doc_id % 6 = 0 THEN 'word-1882' WHEN doc_id % 12 = 3 THEN 'sacred-texts' END AS preamble_source
        FROM documents""",
    "records": """
        SELECT chapter_id, d, 0 AS ord, NULL AS verse_number, 0 AS part, 'preamble' AS label, 'Epigraph ' || en AS en,
               CASE WHEN d % 6 = 0 THEN '序' || lower(en) END AS zh_hant, CASE WHEN d % 5 = 0 THEN en END AS zh_hans, NULL AS ja
        FROM verses WHERE o = 1
        UNION ALL SELECT chapter_id, d, ord, verse_number, 0, 'verse ' || ord, en, zh_hant, zh_hans, ja FROM verses
        UNION ALL SELECT chapter_id, d, ord, verse_number, 1, 'caption ' || verse_id || '#0', 'Plate ' || (d % 50) || ' ' || en,
               CASE WHEN d % 2 = 0 THEN '圖' || lower(en) END, CASE WHEN d % 3 = 0 THEN en END, NULL
        FROM verses WHERE n_images > 0""",
    "books": """
        SELECT source AS slug, CASE WHEN k % 2 = 0 THEN 'Book ' || k END AS title,
               n + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS chapter_count, k AS position
        FROM (SELECT source, regexp_extract(source, '(\\d+)$', 1)::BIGINT AS k, count(*) AS n
              FROM documents GROUP BY 1) WHERE k < 15""",
    "terms": f"""
        SELECT 't' || i AS slug, tok[1] || ' ' || tok[2] AS term,
               CASE WHEN i % 2 = 0 THEN 'name' ELSE 'term' END AS category,
               tok[1] || ' ' || tok[2] AS form2, tok[1] || ' ' || tok[2] || ' ' || tok[3] AS form3,
               '譯' || tok[2] AS zh_hant, tok[2] AS zh_hans,
               CASE WHEN i % 3 <> 0 THEN 'ア' || tok[1] END AS ja,
               CASE WHEN i % 5 <> 0 THEN 'About ' || tok[1] || ' ' || tok[2] || ' ' || tok[3] END AS source_def,
               CASE WHEN i % 4 = 0 THEN '注' END AS lit_hant,
               'Note ' || i AS note_en, '記' AS note_hant, '记' AS note_hans,
               CASE WHEN i % 2 = 0 THEN 'メモ' END AS note_ja, i AS position, i
        FROM (SELECT item_id AS i, {tokens('text')} AS tok FROM benchmark) WHERE len(tok) >= 3""",
    "forms": """
        SELECT slug, form2 AS form FROM terms UNION SELECT slug, form3 FROM terms""",
    "toks": f"""
        SELECT *, ' ' || array_to_string({tokens('en')}, ' ') || ' ' AS hay FROM verses""",
    "edges": """
        SELECT DISTINCT t.book, t.chapter, t.chapter_id, t.o AS ord, t.verse_id, f.slug
        FROM toks t JOIN forms f ON contains(t.hay, ' ' || f.form || ' ')""",
    "rverses": """
        SELECT *, o AS ord,
               CASE WHEN d % 13 = 1 AND o = 2 THEN 'x.' || d || '.' || o ELSE verse_id END AS r_id,
               CASE WHEN d % 19 = 1 AND o = 1 THEN 'カ' || en ELSE '新' || en END AS r_hant,
               CASE WHEN d % 17 = 1 AND o = 1 THEN ' ' ELSE '新' || lower(en) END AS r_hans,
               'ア' || en AS r_ja,
               CASE WHEN o % 4 = 0 THEN 't' || (o % 50) END AS r_tag
        FROM (SELECT *, max(o) OVER (PARTITION BY d) AS n FROM verses WHERE d % 2 = 1)
        WHERE NOT (d % 11 = 1 AND n > 1 AND o = n)""",
    "rcaps": """
        SELECT d, chapter_id, verse_id || '#0' AS cap_idx, '圖新' AS c_hant, '图新' AS c_hans,
               CASE WHEN o % 20 <> 0 THEN '図新' END AS c_ja
        FROM verses WHERE d % 2 = 1 AND o % 10 = 0 AND d % 5 <> 1
        UNION ALL SELECT doc_id, source || '.' || doc_id, source || '.' || doc_id || '.0#9', '多', '多', '多'
        FROM documents WHERE doc_id % 2 = 1 AND doc_id % 15 = 7""",
    "overlay": """
        SELECT d.source AS book, d.doc_id AS chapter,
               CASE WHEN quality = 1 THEN 'Overlay ' || d.doc_id ELSE '' END AS epigraph
        FROM labels l JOIN documents d USING (doc_id)
        UNION ALL SELECT 'lost', doc_id, 'Lost' FROM labels WHERE doc_id % 50 = 0""",
    "stored": """
        SELECT doc_id AS d, 's' || doc_id AS slug, 'Term ' || doc_id AS term,
               CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE '甲' || doc_id END AS hant,
               CASE WHEN doc_id % 5 <> 0 THEN '乙' || doc_id END AS hans,
               CASE WHEN doc_id % 7 <> 0 THEN 'ア' || doc_id END AS ja,
               CASE WHEN doc_id % 6 = 1 THEN ['form ' || doc_id] END AS source_forms,
               CASE WHEN doc_id % 8 = 0 THEN 'x.1' END AS first_seen
        FROM documents WHERE doc_id % 3 <> 0""",
    "delta": """
        SELECT doc_id AS d, 's' || doc_id AS slug, c, doc_id * 10 + c AS pos, source || '.' || doc_id AS chapter_id,
               CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'coin' ELSE 'fill' END AS kind,
               'Term ' || doc_id || '/' || c AS term,
               CASE WHEN c = 1 THEN '新' || doc_id ELSE '再' || doc_id END AS hant,
               CASE WHEN doc_id % 2 = 1 THEN '乙' || doc_id END AS hans,
               CASE WHEN c = 2 THEN 'カ' || doc_id END AS ja,
               CASE WHEN doc_id % 4 = 0 THEN '記' END AS note_hant
        FROM documents, (SELECT unnest([1, 2]) AS c) WHERE c = 1 OR doc_id % 2 = 0""",
    "elements": """
        SELECT d AS page_id, book AS source, o AS pos, en AS line, o % 12 AS m, (o - 2) // 12 + 1 AS k,
               CASE WHEN o = 1 OR o % 24 = 13 OR o % 12 = 2 THEN 'a' WHEN o % 12 IN (7, 11) THEN 'img' ELSE 'p' END AS tag,
               CASE WHEN o % 12 IN (7, 11) AND o <> 1 AND o % 24 <> 13 THEN 'x_files/image' || (o % 40) || '.jpg' END AS src,
               CASE WHEN o = 1 THEN 'title' WHEN o % 24 = 13 THEN 'gallery' WHEN o % 12 = 2 THEN 'chapter' END AS anchor
        FROM v0""",
    "placed": """
        SELECT *,
               last_value(CASE WHEN anchor IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS seg,
               last_value(anchor IGNORE NULLS) OVER w AS seg_kind,
               last_value(CASE WHEN anchor = 'chapter' THEN k WHEN anchor IS NOT NULL THEN 0 END IGNORE NULLS) OVER w AS chap
        FROM elements
        WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "marked": r"""
        SELECT *, tag = 'p' AND chap > 0 AND m NOT IN (3, 4)
                  AND trim(regexp_replace(line, '[\s\x{00A0}]+', ' ', 'g')) <> '' AS is_verse
        FROM placed""",
    "walked": """
        SELECT *,
               last_value(CASE WHEN is_verse THEN pos END IGNORE NULLS) OVER b AS last_pos,
               last_value(CASE WHEN is_verse THEN seg END IGNORE NULLS) OVER b AS last_seg,
               first_value(CASE WHEN is_verse THEN pos END IGNORE NULLS) OVER a AS next_pos,
               first_value(CASE WHEN is_verse THEN seg END IGNORE NULLS) OVER a AS next_seg
        FROM marked
        WINDOW b AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               a AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "roles": r"""
        SELECT page_id, pos, source, seg, chap, line, src, m, k,
               CASE WHEN is_verse THEN 'verse'
                    WHEN tag = 'p' AND chap > 0 AND coalesce(last_seg, -1) <> seg AND m <> 3
                         AND trim(regexp_replace(CASE WHEN m = 4 THEN line ELSE pos || '. ' || line END, '[\s\x{00A0}]+', ' ', 'g')) <> ''
                         THEN 'preamble'
                    WHEN tag = 'img' AND seg IS NOT NULL THEN 'image' END AS role,
               CASE WHEN seg_kind = 'gallery' THEN e.eseg WHEN tag <> 'img' THEN seg
                    WHEN coalesce(last_seg, -1) = seg THEN last_seg ELSE next_seg END AS target_seg,
               CASE WHEN seg_kind = 'gallery' THEN e.epos WHEN tag <> 'img' THEN pos
                    WHEN coalesce(last_seg, -1) = seg THEN last_pos ELSE next_pos END AS target_pos
        FROM walked LEFT JOIN (SELECT page_id AS ep, max(seg) AS eseg, max(pos) AS epos FROM walked
                               WHERE is_verse AND chap = 1 GROUP BY 1) e
             ON seg_kind = 'gallery' AND page_id = ep AND eseg < seg""",
    "ranges": """
        SELECT DISTINCT (doc_id // 100) * 100 AS lo, (doc_id // 100) * 100 + 69 AS hi,
               'r' || (doc_id // 100) AS slug, 'Range ' || (doc_id // 100) AS title
        FROM documents WHERE (doc_id // 100) % 8 <> 7""",
    "flat": """
        SELECT page_id, unnest(cuts) AS cut, generate_subscripts(cuts, 1) - 1 AS pos FROM (
        SELECT page_id, regexp_extract_all(html, '(?s)<[a-zA-Z][a-zA-Z0-9]*[^>]*>[^<]*') AS cuts FROM pages)""",
}

NEEDS = {
    "verses": ["v0"], "records": ["verses"], "forms": ["terms"], "toks": ["verses"], "edges": ["toks", "forms"],
    "rverses": ["verses"], "rcaps": ["verses"], "elements": ["v0"], "placed": ["elements"],
    "marked": ["placed"], "walked": ["marked"], "roles": ["walked"],
}


def query(needs: str, body: str) -> str:
    """``WITH`` the named expressions (and what they need) around ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    if not order:
        return body
    # A body may go on with further named expressions after a leading comma.
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body.strip()
