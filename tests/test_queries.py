"""Every registered query against its SQL on the smallest tables.

The default run takes a cross-section; LECTERN_ALL_QUERIES=1 runs all of them.
"""

import os

import pytest

import __spark_entry__ as driver
from tests.compare import compare, connect

SF = os.environ.get("LECTERN_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = driver.queries(), driver.oracle_sql()
SAMPLE = (
    "P1_collapse P13_normalise P15_ngrams A3_translation_coverage A7_max_images J1_range_assign J11_asof_hit J5_term_regex "
    "W8_neighbours W9_book_position FP3_book_fp A4_backlink_summary T4_annotate T6_search_verses U1_precedence_fill "
    "U8_commit_report Q5_Q6_chapters Q13_lock_check S10_render_pages W3_W4_attach_images R2_debounce"
).split()
NAMES = list(QUERIES) if os.environ.get("LECTERN_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name not in SQL:
        assert df.count() > 0
        return
    same, note = compare(df, con, SQL[name])
    assert same, note


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 150


def test_entry(spark):
    out = driver.entry(spark)
    assert out.columns == ["slug", "part_no", "verse_ids"] and out.count() > 0


def test_annotation_of_several_terms(spark):
    """The query without SQL, against a left-to-right scan in Python."""
    from lectern.operators import corpus as C
    from lectern.plans import binding as B
    from lectern.plans.term_queries import edges

    terms = {r.slug: r for r in B.terms(spark, SF).collect()}
    verses = {(r.chapter_id, r.ord): r for r in C.verses_of(B.chapters(spark, SF)).collect()}
    tags: dict = {}
    for e in edges(spark, SF).collect():
        tags.setdefault((e.chapter_id, e.ord), []).append(e.slug)

    def present(term, english):
        import re

        stem = re.sub("[^A-Za-z]", "", term)[:4]
        return not english or bool(re.search(rf"(?i)(?<![A-Za-z]){re.escape(term)}(?![A-Za-z])", english)) or (
            len(stem) >= 4 and bool(re.search(rf"(?i)(?<![A-Za-z]){stem}", english)))

    def annotate(key):
        v = verses[key]
        text = v.zh_hans or ""
        pairs = sorted(
            ((-len(t.translit.zh_hans), t.position, t.translit.zh_hans, t.term) for t in (terms[s] for s in tags.get(key, []))
             if present(t.term, v.en)))
        out, i = "", 0
        while i < len(text):
            hit = next((p for p in pairs if text.startswith(p[2], i)), None)
            out += f"{hit[2]}（{hit[3]}）" if hit else text[i]
            i += len(hit[2]) if hit else 1
        return out

    got = {(r.chapter_id, r.ord): r.annotated for r in QUERIES["T4_annotate_all"](spark, SF).collect()}
    assert got == {k: annotate(k) for k in verses}
