from pyspark.sql import functions as F

from tests.compare import rows
from lectern.operators import segment as G
from lectern.sources import html as H

KIND = "page_id bigint, pos bigint, tag string, name string, src string, text string"


def stream(spark, items):
    out = []
    for pos, (tag, value) in enumerate(items):
        out.append((1, pos, tag, value if tag == "a" else None, f"x_files/image{value}.jpg" if tag == "img" else None, value if tag == "p" else ""))
    return spark.createDataFrame(out, KIND)


ANCHORS = [("bkx", "title", "x", None), ("bky", "title", "y", None), ("sec", "section", None, None), ("x", "chapter", "x", None),
           ("y", "chapter", "y", None), ("pics", "gallery_last_verse", "x", 1), ("front", "gallery_frontispiece", "y", 1)]


def chapters(spark, items):
    e = stream(spark, items)
    out = G.assemble_chapters(G.standard_rows(e, H.anchor_table(ANCHORS, spark)))
    return {r.id: (r.preamble.en, [(v.verse_number, v.en, [i.src[13:-4] for i in v.images or []]) for v in r.verses]) for r in out.collect()}


def test_segmentation_script(spark):
    got = chapters(spark, [
        ("a", "bkx"), ("img", "A"), ("a", "x1"), ("p", "CHAPTER 1."), ("p", "Epigraph."), ("p", "1. one"), ("img", "B"),
        ("p", "2. two"), ("a", "x2"), ("img", "C"), ("a", "x3"), ("p", "1. three"), ("img", "D"), ("a", "pics"), ("img", "E"),
    ])
    # C waits through the chapter without verses; D follows a verse of its chapter.
    assert got == {
        "x.1": ("Epigraph.", [(1, "one", ["A", "B"]), (2, "two", ["E"])]),
        "x.3": (None, [(1, "three", ["C", "D"])]),
    }


def test_frontispiece_sections_and_strays(spark):
    got = chapters(spark, [
        ("img", "stray"), ("a", "bkx"), ("a", "x1"), ("p", "1. a p. 9 b"), ("p", "loose text"), ("a", "plate_1"), ("p", "7."),
        ("a", "front"), ("img", "F"), ("p", "1. not a verse"), ("a", "bky"), ("img", "G"), ("a", "y1"), ("p", "pre one"), ("p", "pre two"),
        ("p", "1. y one"), ("a", "sec"), ("p", "1. in a section book"), ("img", "lost"),
    ])
    assert got == {"x.1": (None, [(1, "a b", [])]), "y.1": ("pre one pre two", [(1, "y one", ["F", "G"])])}


def test_repeated_chapter_replaces(spark):
    got = chapters(spark, [("a", "x1"), ("p", "1. old"), ("img", "O"), ("a", "x1"), ("p", "1. new"), ("a", "x1"), ("p", "no verse")])
    assert got == {"x.1": (None, [(1, "new", [])])}


def test_caption_map_is_the_inventory(spark):
    e = stream(spark, [("a", "x1"), ("p", "1. v"), ("img", "A"), ("img", "B"), ("img", "C")])
    captions = spark.createDataFrame([("imageA.jpg", "Cap A"), ("imageB.jpg", None)], "file string, caption string")
    out = G.assemble_chapters(G.standard_rows(e, H.anchor_table(ANCHORS, spark)), captions)
    images = out.head().verses[0].images
    assert [(i.src[-10:], i.caption.en if i.caption else None) for i in images] == [("imageA.jpg", "Cap A"), ("imageB.jpg", None)]


def test_sections(spark):
    e = stream(spark, [
        ("p", "before"), ("a", "s_one"), ("img", "A"), ("p", "no verse"), ("a", "s_two"), ("p", "CHAPTER 2."), ("p", "1. a"),
        ("img", "B"), ("p", "2. b"), ("img", "C"), ("a", "plate_x"), ("a", "s_three"), ("p", "1. c"), ("a", "other"), ("p", "2. outside"),
    ])
    out = G.section_rows(e, "s_", "s", skip=["plate_"])
    got = G.assemble_chapters(out)
    found = {r.id: (r.preamble.en, [(v.en, [i.src[13:-4] for i in v.images or []]) for v in r.verses]) for r in got.collect()}
    assert found == {"s.1": ("CHAPTER 2.", [("a", ["A"]), ("b", ["B", "C"])]), "s.2": (None, [("c", [])])}


def test_implicit_numbering(spark):
    p = spark.createDataFrame(
        [(1, 0, "Hints", "Hints"), (1, 1, "p. 6", "Hints"), (1, 2, "First", "Hints"), (1, 3, "Hints.", "Hints"), (1, 4, "Second", "Hints"),
         (2, 0, "Title", "Title"), (2, 1, "Intro", "Title"), (2, 2, "1. v", "Title"), (2, 3, "after", "Title")],
        "page_id bigint, pos bigint, text string, title string")
    assert rows(G.page_paragraphs(p), "page_id", "role", "number", "text") == [
        (1, "verse", 1, "First"), (1, "verse", 2, "Second"), (2, "preamble", None, "Intro"), (2, "verse", 1, "v")]


def test_shredder(spark):
    html = (
        '<html><body><script>var a="<p>no</p>";</script><p>1. one <a name="x2">t</a> end<p>open <b>Bold.</b> rest'
        '<img src="i_files/image1.jpg"></p><dl><dt>Term:<dd>Its &amp; meaning<dt><b>Last</b></dl></body></html>'
    )
    e = H.shred_html(spark.createDataFrame([(1, html), (2, None)], "page_id bigint, html string"))
    assert rows(e, "pos", "tag", "name", "text", "last") == [
        (0, "p", None, "1. one t end", 1), (1, "a", "x2", "t", 1), (2, "p", None, "open Bold. rest", 4), (3, "b", None, "Bold.", 3),
        (4, "img", None, "", 4), (5, "dt", None, "Term:", 5), (6, "dd", None, "Its & meaning", 6), (7, "dt", None, "Last", 8), (8, "b", None, "Last", 8)]
    data = "né <p>caf\x81é".encode("latin-1")
    b = H.shred_html(spark.createDataFrame([(1, bytearray(data))], "page_id bigint, html binary"), codec="windows-1252")
    assert b.head().text == "caf�é"


def test_headwords(spark):
    html = ("<p><b>Ashar.</b> — A guardian</p><p>plain</p><dl><dt>Es:</dt><dd>The unseen</dd><dt>Ashar</dt><dd>later</dd><dt>Bare</dt></dl>"
            "<p>x <a><b>Deep</b></a></p>")
    e = H.shred_html(spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    got = H.headwords(e)
    assert rows(got.where("slug <> 'deep'"), "term", "definition") == [("Ashar", "A guardian"), ("Bare", ""), ("Es", "The unseen")]


def test_plates(spark):
    v = spark.createDataFrame([("img/03700.jpg",), ("9.jpg",), (None,)], "src string")
    plates = spark.createDataFrame([("03700", 4)], "img_id string, id int")
    assert sorted(r.plate_ref or 0 for r in G.plate_refs(v, plates).collect()) == [0, 0, 4]


def test_epigraph(spark):
    p = spark.createDataFrame([(1, 0, "p. 68a"), (1, 1, "CHAPTER 4"), (1, 2, "Words  of old"), (1, 3, "my.site | x"), (1, 4, "More"), (1, 5, "1. verse"), (1, 6, "no"), (2, 0, "1. v")],
                              "page_id bigint, pos bigint, text string")
    assert rows(G.epigraphs(p, "my.site")) == [(1, "Words of old More"), (2, "")]
