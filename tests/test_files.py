import json
import os

import pytest
from pyspark.sql import functions as F

from tests.compare import rows
from lectern import schemas
from lectern.operators import corpus as C
from lectern.operators import fingerprint as FP
from lectern.operators import quality as K
from lectern.sources import files as FS
from lectern.sources import html as H
from lectern.sources import pages as P


def doc(book, n, verses, **extra):
    base = {
        "id": f"{book}.{n}", "book": book, "chapter": n, "title": f"{book} {n}",
        "preamble": {"en": None, "zh_hant": None, "zh_hans": None, "ja": None}, "preamble_source": None,
        "verses": [
            {"id": f"{book}.{n}.{v}", "verse_number": v, "en": t, "zh_hant": None, "zh_hans": None, "ja": None,
             "glossary_terms": [], "plate_ref": None, "notes": []} for v, t in verses
        ],
    }
    base.update(extra)
    return base


@pytest.fixture
def corpus(tmp_path):
    image = {"src": "/p/a.jpg", "edition": "1", "caption": {"en": "Cap", "zh_hant": None, "zh_hans": None, "ja": None}}
    one = doc("b", 1, [(1, "one"), (2, "two")])
    one["verses"][1]["images"] = [image, {"src": "/p/b.jpg", "edition": "1"}]
    for d in (one, doc("b", 10, [(3, "x"), (4, None)]), doc("a", 2, [(1, "z")])):
        folder = tmp_path / "books" / d["book"]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"chapter-{d['chapter']:02d}.json").write_text(json.dumps(d, indent=2), encoding="utf-8")
    (tmp_path / "books" / "b" / "notes.json").write_text("{}")
    return tmp_path


def test_read_write_round_trip(spark, corpus):
    ch = FS.read_chapters(spark, str(corpus / "books"))
    assert rows(ch, "id", F.size("verses")) == [("a.2", 1), ("b.1", 2), ("b.10", 2)]
    FS.write_chapters(ch.drop("path"), str(corpus / "out"))
    back = FS.read_written_chapters(spark, str(corpus / "out"))
    names = [f.name for f in schemas.CHAPTER.fields]
    assert rows(back, *names) == rows(ch, *names)
    raw = spark.read.text(str(corpus / "out")).where("value like '%b.1\"%'").head().value
    assert json.loads(raw)["verses"][1]["images"][1] == {"src": "/p/b.jpg", "edition": "1"}
    assert "images" not in json.loads(raw)["verses"][0]
    assert FS.write_if_changed(back.select(*names), ch.select(*names), ["id"], str(corpus / "out")) == 0
    edited = ch.select(*names).withColumn("title", F.when(F.col("id") == "b.1", "new").otherwise(F.col("title")))
    assert FS.write_if_changed(back.select(*names), edited, ["id"], str(corpus / "out")) == 1
    assert rows(FS.read_written_chapters(spark, str(corpus / "out")), "id", "title") == [("a.2", "a 2"), ("b.1", "new"), ("b.10", "b 10")]


def test_nest_is_inverse_of_explode(spark, corpus):
    ch = FS.read_chapters(spark, str(corpus / "books")).drop("path")
    nested = C.nest_verses(C.verses_of(ch).repartition(3), ch.drop("verses"))
    assert rows(nested, "id", "verses") == rows(ch, "id", "verses")


def test_file_names(spark):
    df = spark.createDataFrame([("b", 3), ("b", 123)], "b string, n bigint")
    assert [r.f for r in df.select(FS.chapter_file_name(F.col("b"), F.col("n")).alias("f")).collect()] == ["b/chapter-03.json", "b/chapter-123.json"]


def test_dimension_keeps_order_and_may_be_missing(spark, tmp_path):
    (tmp_path / "books.json").write_text(json.dumps([{"slug": "z", "title": "Z", "chapter_count": 1}, {"slug": "a", "title": "A", "chapter_count": 2}], indent=1))
    assert rows(FS.read_dimension(spark, str(tmp_path / "books.json"), schemas.BOOK), "position", "slug") == [(0, "z"), (1, "a")]
    assert FS.read_dimension(spark, str(tmp_path / "none.json"), schemas.BOOK).count() == 0


def test_html_files_and_inventory(spark, tmp_path):
    for n in (2, 10):
        (tmp_path / f"pg{n}.htm").write_bytes(b"<p>caf\xe9</p>")
    (tmp_path / "index.htm").write_bytes(b"<p>i</p>")
    pages = H.read_html(spark, str(tmp_path), "windows-1252")
    texts = H.shred_html(pages, "windows-1252")
    assert rows(texts.where("text <> 'i'"), "page_id", "text") == [(10, "café"), (2, "café")]
    assert rows(FS.read_inventory(spark, str(tmp_path), r"^pg(\d+)\.htm$"), "number") == [(10,), (2,)]


def test_worklist_skips_and_counts(spark):
    todo = FS.worklist(spark, 2, 12, "pg%02d.htm")
    done = spark.createDataFrame([(3,), (4,), (99,)], "number bigint")
    left = FS.skip_existing(todo, done, ["number"])
    assert left.count() == 9 and todo.orderBy("number").head().name == "pg02.htm"
    assert FS.skipped_count(todo, done, ["number"]).head().skipped == 2
    assert FS.skip_existing(todo, done, ["number"], force=True).count() == 11


def test_snapshot_publish_read_tamper(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert FS.read_snapshot(spark, root).count() == 0
    kind = "book string, part string, slug string, payload string"
    parts = spark.createDataFrame([("b", "terms", f"s{i}", f"p{i}") for i in range(20)] + [("c", "terms", "s", None)], kind)
    first = rows(FS.publish_snapshot(parts, root), "book", "version")
    assert rows(FS.publish_snapshot(parts.repartition(5), root), "book", "version") == first
    assert rows(FS.read_snapshot(spark, root), "book", "slug", "payload") == rows(parts, "book", "slug", "payload")
    changed = parts.withColumn("payload", F.when(F.col("slug") == "s3", "edited").otherwise(F.col("payload")))
    second = dict(rows(FS.publish_snapshot(changed.where("book = 'b'"), root), "book", "version"))
    assert second["c"] == dict(first)["c"] and second["b"] != dict(first)["b"]
    assert len(os.listdir(tmp_path / "snap" / "content" / "book=b")) == 2
    forged = changed.where("book = 'b'").withColumn("payload", F.lit("forged")).withColumn("version", F.lit(second["b"]))
    with pytest.raises(Exception, match="does not match"):
        FS.verified(forged).collect()


def test_second_writer_is_refused(spark, tmp_path):
    root = str(tmp_path / "snap")
    kind = "book string, part string, slug string, payload string"
    parts = spark.createDataFrame([("b", "terms", "s", "1")], kind)
    later = parts.withColumn("payload", F.lit("2"))
    FS.publish_snapshot(parts, root)
    assert FS.published(spark, root) == 1
    with pytest.raises(FS.StaleSnapshot):
        FS.publish_snapshot(later, root, base=0)
    assert rows(FS.read_snapshot(spark, root), "payload") == [("1",)]
    FS.publish_snapshot(later, root, base=1)
    assert rows(FS.read_snapshot(spark, root), "payload") == [("2",)]
    assert rows(FS.read_snapshot(spark, root, 1), "payload") == [("1",)]


def test_only_changed_books_are_written(spark, corpus, tmp_path):
    root = str(tmp_path / "out")
    ch = FS.read_chapters(spark, str(corpus / "books")).drop("path")
    assert rows(FS.write_changed_books(ch, root), "book") == [("a",), ("b",)]
    stamp = {f: os.path.getmtime(f) for f in (tmp_path / "out" / "books").rglob("*.txt")}
    assert rows(FS.write_changed_books(ch.repartition(3), root), "book") == []
    assert stamp == {f: os.path.getmtime(f) for f in (tmp_path / "out" / "books").rglob("*.txt")}
    edited = ch.withColumn("title", F.when(F.col("id") == "b.10", "new").otherwise(F.col("title")))
    assert rows(FS.write_changed_books(edited, root), "book") == [("b",)]
    left = {f for f in (tmp_path / "out" / "books").rglob("*.txt")}
    assert {f for f in stamp if "book=a" in str(f)} <= left and FS.read_written_chapters(spark, f"{root}/books").count() == ch.count()


def test_fingerprints(spark, corpus):
    import hashlib

    def sha(t):
        return hashlib.sha256((t or "").encode()).hexdigest()[:16]

    ch = FS.read_chapters(spark, str(corpus / "books")).drop("path")
    want = sha("|".join([f"v:b.1.1:{sha('one')}", f"v:b.1.2:{sha('two')}", f"p:{sha(None)}", f"c:b.1.2#0:{sha('Cap')}"]))
    got = {r.chapter_id: r.src_sha for r in FP.chapter_fingerprints(ch).collect()}
    assert got["b.1"] == want
    books = {r.book: r.book_en_sha for r in FP.book_fingerprints(FP.chapter_fingerprints(ch)).collect()}
    assert books == {"a": book_digest(sha, {2: got["a.2"]}), "b": book_digest(sha, {1: got["b.1"], 10: got["b.10"]})}
    kinds = {r.kind: r["count"] for r in FP.build_manifest(ch).groupBy("kind").count().collect()}
    assert kinds == {"verse": 5, "preamble": 3, "caption": 1}


def test_malformed_chapters_are_reported(spark, corpus):
    (corpus / "books" / "b" / "chapter-11.json").write_text('{"id": "b.11", ')
    (corpus / "books" / "b" / "chapter-12.json").write_text("[1]")
    bad = K.check_chapters(FS.read_chapter_texts(spark, str(corpus / "books")))
    assert rows(bad, "rule", F.element_at(F.split("path", "/"), -1)) == [("chapter.json", "chapter-11.json"), ("chapter.json", "chapter-12.json")]
    v = C.verses_of(FS.read_chapters(spark, str(corpus / "books")).where("id is not null"))
    assert rows(K.check_verses(v), "rule", "id") == [("verse.en", "b.10.4")]
    assert rows(K.check_identity(v), "rule", "id") == [("identity.numbering", "b.10.3"), ("identity.numbering", "b.10.4")]


def test_pages(spark, corpus):
    ch = FS.read_chapters(spark, str(corpus / "books")).drop("path")
    ch = ch.withColumn("preamble", F.struct(F.lit("Line 1\nLine 2").alias("en"), *[F.lit(None).cast("string").alias(x) for x in ("zh_hant", "zh_hans", "ja")]))
    books = spark.createDataFrame([("b", "Book B", 0)], "slug string, title string, position int")
    numbered = C.number_books(ch, books)
    assert rows(numbered, "book", "title", "position") == [("a", "A", 2), ("b", "Book B", 1)]
    pages = {r.path: r.body for r in P.render_chapters(ch, numbered).collect()}
    assert set(pages) == {"a", "b/01", "b/10"}
    assert pages["b/01"].endswith("hidePreamble: true\n") and "hidePreamble" not in pages["b/10"] + pages["a"]
    assert 'title: "A"' in pages["a"] and 'sidebar_label: "Chapter 10"' in pages["b/10"]
    index = P.book_indexes(ch, numbered).collect()
    assert len(index) == 1 and "\n> Line 1\n> Line 2\n" in index[0].body
    assert index[0].body.endswith("- [Chapter 1](/b/b.1)\n- [Chapter 10](/b/b.10)\n")
    assert rows(P.top_index(numbered, books, "All"), "line") == [("# All",), ("- [Book B](./b/)",)]
    assert P.placeholder(numbered).count() == 0 and P.placeholder(numbered.limit(0)).count() == 1
    P.write_pages(P.render_chapters(ch, numbered), str(corpus / "pages"))
    assert spark.read.parquet(str(corpus / "pages")).count() == 3


def test_terms_that_share_a_headword_stay_in_the_slice(spark, corpus):
    ch = FS.read_chapters(spark, str(corpus / "books")).drop("path")
    books = spark.createDataFrame([("b", "Book B", 0)], "slug string, title string, position int")
    kind = "slug string, term string, translit struct<zh_hant:string,ja:string>, position int"
    terms = spark.createDataFrame([("t9", "El", ("甲", None), 2), ("t10", "El", ("乙", "ア"), 1), ("t1", "Abram", ("丙", None), 3)], kind)
    edges = spark.createDataFrame([("b.1", slug) for slug in ("t9", "t1", "t10")], "chapter_id string, slug string")
    pages = {r.path: r.body for r in P.render_chapters(ch, C.number_books(ch, books), P.slice_maps(edges, terms)).collect()}
    own = pages["b/01"].split("\nglossary: ")[1].split("\n")[0]
    assert json.loads(own, object_pairs_hook=list) == [
        ("Abram", [("translit", [("zh_hant", "丙")]), ("slug", "t1")]),
        ("El", [("translit", [("zh_hant", "乙"), ("ja", "ア")]), ("slug", "t10")]),
        ("El", [("translit", [("zh_hant", "甲")]), ("slug", "t9")]),
    ]
    assert "\nglossary: {}\n" in pages["b/10"]


def book_digest(sha, chapters):
    """The tree over four, two and no hash digits of the chapter keys, in plain Python."""
    level = {k: (sha(k), sha(d)) for k, d in ((f"chapter\x01{n}", d) for n, d in chapters.items())}
    for digits in (4, 2, 0):
        groups = {}
        for key, (b, x) in sorted(level.items()):
            groups.setdefault(b[:digits], []).append(f"{key}={x}")
        level = {b: (b, sha("\n".join(own))) for b, own in groups.items()}
    return level[""][1]


def test_book_digest_has_one_rule_for_any_numbers(spark):
    import hashlib

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()[:16]

    data = {"b": {2**50: "r", 4096: "q", 4095: "p"}, "c": {1: "p"}, None: {5: "z"}, "big": {k: f"d{k}" for k in range(5000)}}
    books = spark.createDataFrame([(b, c, x) for b, own in data.items() for c, x in own.items()], "book string, chapter bigint, src_sha string")
    got = {r.book: r.book_en_sha for r in FP.book_fingerprints(books.repartition(7)).collect()}
    assert got == {b: book_digest(sha, own) for b, own in data.items()}


def test_workers_import_the_package_from_anywhere(tmp_path):
    """A query with Python workers runs from another folder, without PYTHONPATH."""
    import subprocess
    import sys

    from tests.conftest import ROOT

    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "import __spark_entry__ as e\n"
        "from lectern.session import local_session\n"
        "spark = local_session(2, 2)\n"
        "assert e.queries()['S4_shred_html'](spark, '/root/testdata/sf0.001').count() > 0\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
