from pyspark.sql import functions as F

from tests.compare import rows
from lectern import schemas
from lectern.operators import merge as M

TERM = ("slug string, term string, category string, translit struct<zh_hant:string,zh_hans:string,ja:string>, "
        "source_def string, source_def_literal struct<zh_hant:string,zh_hans:string,ja:string>, "
        "editor_note struct<en:string,zh_hant:string,zh_hans:string,ja:string>, source_forms array<string>, "
        "locked boolean, first_seen string")
NO3, NO4 = (None,) * 3, (None,) * 4


def terms(spark, items):
    return spark.createDataFrame([(s, s.upper(), "name", tl, None, NO3, NO4, None, False, None) for s, tl in items], TERM)


def delta(spark, items):
    data = [(k, i, "x.1", s, t, "term", tl, None, NO3, NO4, forms, None, None) for i, (k, s, t, tl, forms) in enumerate(items)]
    return spark.createDataFrame(data, "kind string, pos int, chapter_id string, " + TERM)


def lexicon(spark, items, pos=False):
    names = "en string, zh_hant string, zh_hans string, ja string" + (", pos int" if pos else "")
    return spark.createDataFrame([(*i, n) if pos else i for n, i in enumerate(items)], names)


def test_three_fill_rules(spark):
    df = spark.createDataFrame([("", "x"), ("o", "x"), (None, "x"), ("o", ""), ("", None), (None, None)], "o string, n string")
    o, n = F.col("o"), F.col("n")
    got = [tuple(r) for r in df.select(M.fill_nulls(o, n), M.fill_blank(o, n), M.overwrite_nonblank(o, n)).collect()]
    assert got == [("", "x", "x"), ("o", "o", "x"), ("x", "x", "x"), ("o", "o", "o"), ("", "", ""), (None, None, None)]


def test_coin_then_fill(spark):
    out = M.coin_or_fill(
        terms(spark, [("a", ("甲", None, ""))]),
        delta(spark, [
            ("coin", "n", "New", ("新", None, None), None), ("coin", "n", "Newer", ("再", "二", None), None),
            ("fill", "n", "?", ("先", None, None), None), ("fill", "a", "?", ("乙", "丙", "x"), None), ("fill", "zz", "?", ("q", "q", "q"), None),
        ]),
    )
    got = {r.slug: (r.term, tuple(r.translit), r.outcome, r.locked, r.filled_fields, r.first_seen) for r in out.collect()}
    assert got == {
        "n": ("New", ("新", "二", None), "coined", True, [], "x.1"),
        "a": ("A", ("甲", "丙", ""), "filled", False, ["translit.zh_hans"], "x.1"),
    }


def test_only_a_fill_with_effect_marks_a_term(spark):
    out = M.coin_or_fill(
        terms(spark, [("a", ("甲", "乙", None)), ("b", ("甲", "乙", None))]),
        delta(spark, [
            ("fill", "a", "?", ("別", "別", None), None), ("coin", "a", "A", (None, None, "ア"), None),
            ("coin", "b", "B", (None, None, "イ"), None), ("fill", "b", "?", (None, None, "ア"), None),
        ]),
    )
    got = {r.slug: (tuple(r.translit), r.outcome, bool(r.locked), r.first_seen) for r in out.collect()}
    # The fill of "a" met no null, so its coin fills without marking; the fill of "b" comes first.
    assert got == {
        "a": (("甲", "乙", "ア"), "filled", False, None),
        "b": (("甲", "乙", "ア"), "filled", True, "x.1"),
    }


def test_commit_keeps_or_refuses(spark):
    base = terms(spark, [("a", ("甲", "", None)), ("b", ("乙", "乙", "ビ"))])
    lex = lexicon(spark, [("walk", "走", "走", "歩")])
    fills = delta(spark, [("fill", "a", "?", ("別", "丙", "ア"), ["f"]), ("coin", "n", "N", ("新", "新", "ニ"), None)])
    merged, lex2, report = M.commit(base, fills, lex, lexicon(spark, [("run", "跑", "跑", "走"), ("run", "跑", None, "走")], True))
    assert rows(report) == [("coined", "n", ""), ("filled", "a", ""), ("kept_existing", "a", "translit.zh_hant"), ("lexicon", "run", "")]
    assert {r.slug: (tuple(r.translit), r.locked) for r in merged.collect()} == {
        "a": (("甲", "丙", "ア"), True), "b": (("乙", "乙", "ビ"), False), "n": (("新", "新", "ニ"), True)}
    assert rows(lex2, "en") == [("run",), ("walk",)]

    clash = delta(spark, [("fill", "a", "?", (None, "丙", None), None), ("coin", "b", "B", ("錯", "乙", "ビ"), None)])
    merged, lex2, report = M.commit(base, clash, lex, lexicon(spark, [("run", "跑", "跑", "走")], True))
    assert ("conflict", "b", "translit.zh_hant") in rows(report)
    assert {r.slug: tuple(r.translit) for r in merged.collect()} == {"a": ("甲", "", None), "b": ("乙", "乙", "ビ")}
    assert rows(lex2, "en") == [("walk",)]


def test_lexicon_conflict_inside_one_change_set(spark):
    none = delta(spark, [])
    report = M.commit_report(terms(spark, []), none, lexicon(spark, []), lexicon(spark, [("run", "跑", None, "走"), ("run", "奔", "跑", "走")], True))
    assert rows(report) == [("conflict", "run", "lexicon.zh_hant"), ("lexicon", "run", "")]


def test_repair_leaks(spark):
    t = terms(spark, [("es", ("以太", "以太界", "エセ")), ("plain", ("本", "本", "本")), ("un", ("柯", "柯", "コル"))])
    kind = "chapter_id string, ord int, ja string, glossary_terms array<string>"
    v = spark.createDataFrame([("c", 1, "以太界と以太", ["ES"]), ("c", 2, "柯", ["ES"]), ("c", 3, "本", ["PLAIN"]), ("c", 4, "以太", ["es"]), ("c", 5, None, ["ES"])], kind)
    out = M.repair_leaks(v, t)
    # The traditional form is replaced first, also where it is part of the longer one.
    assert rows(out, "ord", "ja", "ja_fixed") == [(1, "エセ界とエセ", True), (2, "柯", False), (3, "本", False), (4, "以太", False), (5, None, False)]


def test_caption_fallback_only_for_single_captions(spark):
    caps = spark.createDataFrame([("c", "v1", "A", None), ("c", "v1", "B", None), ("c", "v2", "A", "old"), ("c", "v3", "C", None)],
                                 "chapter_id string, verse_id string, en string, zh_hant string").withColumn("zh_hans", F.lit(None).cast("string")).withColumn("ja", F.lit(None).cast("string"))
    got = spark.createDataFrame([("v1", None, "x", 0), ("v1", "B", "y", 1), ("v2", None, "z", 2), ("v3", "", "w", 3)],
                                "verse_id string, en string, zh_hant string, pos int").withColumn("zh_hans", F.col("zh_hant")).withColumn("ja", F.col("zh_hant"))
    out = M.match_captions(caps, got)
    assert rows(out, "verse_id", "en", "zh_hant", "matched") == [("v1", "A", None, False), ("v1", "B", "y", True), ("v2", "A", "old", True), ("v3", "C", "w", True)]


def chapter(spark, source, preamble):
    verse = [("a.1.1", 1, "x", None, None, None, [], None, [], None)]
    return spark.createDataFrame([("a.1", "a", 1, "A", preamble, source, verse)], schemas.CHAPTER)


def test_precedence_fill(spark):
    overlay = spark.createDataFrame([("a", 1, "from overlay")], "book string, chapter bigint, epigraph string")
    empty = spark.createDataFrame([("a", 1, "")], "book string, chapter bigint, epigraph string")
    base, none = ("base", "序", None, None), ("", "序", None, None)

    def run(source, pre, side):
        r = M.overlay_preamble(chapter(spark, source, pre), side).head()
        return r.preamble.en, r.preamble.zh_hant, r.preamble_source, r.outcome

    assert run(None, base, overlay) == ("base", "序", "word-1882", "kept")
    assert run(None, none, overlay) == ("from overlay", "序", "sacred-texts", "filled")
    assert run(None, none, empty) == ("", "序", None, "empty")
    assert run("sacred-texts", none, overlay) == ("", "序", "sacred-texts", "already_filled")
    assert run("word-1882", none, overlay) == ("", "序", "word-1882", "kept")
    again = M.overlay_preamble(M.overlay_preamble(chapter(spark, None, none), overlay).drop("outcome", "changed"), overlay)
    assert not again.head().changed


def test_inject_images_once(spark):
    verses = spark.createDataFrame(
        [("a", 1, 1, 7, [("s1", "1", None)]), ("a", 1, 2, 7, None), ("a", 1, 3, 8, None)],
        "book string, chapter bigint, ord int, verse_number int, images array<struct<src:string,edition:string,caption:"
        + schemas.I18N.simpleString() + ">>")
    new = spark.createDataFrame([("a", 1, 7, 0, "s1", "1"), ("a", 1, 7, 1, "s2", "1")],
                                "book string, chapter bigint, verse_number int, pos int, src string, edition string").withColumn(
        "caption", F.lit(None).cast(schemas.I18N))
    once = M.inject_images(verses, new)
    again = M.inject_images(once, new)
    for out in (once, again):
        assert [[i.src for i in r.images or []] for r in out.orderBy("ord").collect()] == [["s1", "s2"], [], []]


def gate_tables(spark):
    """Three chapters of two verses, one with a caption; results for the first two, captions answered twice."""
    image = [("s", "1", ("Plate", None, None, None))]

    def verses(c):
        return [(f"a.{c}.{n}", n, f"Ben {c} {n}", None, None, None, [], None, [], image if (c, n) == (1, 2) else None) for n in (1, 2)]

    ch = spark.createDataFrame(
        [(f"a.{c}", "a", c, "A", ("Epigraph", None, None, None) if c == 1 else None, None, verses(c)) for c in (1, 2, 3)], schemas.CHAPTER)
    texts = "zh_hant:string,zh_hans:string,ja:string"
    res = spark.createDataFrame(
        [("a", f"a.{c}", "v", "s", ("序", "序", "序") if c == 1 else None,
          [("a.1.2#0", "Plate", "旧", "旧", "旧"), ("a.1.2#0", "Plate", "图", "图", "图")] if c == 1 else [],
          [(f"a.{c}.{n}", "本", "本", "本", None) for n in ((1, 2) if c == 1 else (1,))], [], c) for c in (1, 2)],
        f"book string, chapter_id string, snapshot_version string, book_en_sha string, preamble struct<{texts}>, "
        f"captions array<struct<cap_idx:string,en:string,{texts}>>, "
        f"verses array<struct<id:string,{texts},glossary_terms:array<string>>>, unknown_terms array<string>, chapter int")
    return ch, res


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_paired_inside_the_row(spark):
    """One join of nested rows; locks are judged before anything is shuffled again."""
    from lectern.operators import quality as K
    from lectern.operators import terms as T
    from lectern.operators import validate as V

    ch, res = gate_tables(spark)
    got = V.paired_records(ch, res)
    assert rows(got) == [
        ("a.1", "caption a.1.2#0", "Plate", "图", "图", "图"), ("a.1", "preamble", "Epigraph", "序", "序", "序"),
        ("a.1", "verse 1", "Ben 1 1", "本", "本", "本"), ("a.1", "verse 2", "Ben 1 2", "本", "本", "本"),
        ("a.2", "verse 1", "Ben 2 1", "本", "本", "本")]
    assert "Aggregate" not in optimized(got)
    locks = terms(spark, [("ben", ("本", "本", "ベン"))])
    found = K.check_locks(got, locks, T.term_forms(locks))
    assert rows(found, "path", "id") == [("a.1", "verse 1"), ("a.1", "verse 2"), ("a.2", "verse 1")]
    assert "first(zh_hant" not in optimized(found)
    books = spark.createDataFrame([("a", "v", "s")], "book string, version string, book_en_sha string")
    free = locks.where("slug = ''")
    assert rows(V.refused(ch, res, free, books, books.drop("version"))) == [("a.2",)]
    assert {(r.rule, r.path) for r in V.validate_results(ch, res, locks, books, books.drop("version")).collect()} == {
        ("result.lock", "a.1"), ("result.lock", "a.2"), ("result.missing", "a.2"), ("result.order", "a.2")}


def test_only_merged_chapters_meet_their_results(spark):
    """Chapters without a fitting result pass by in place, neither shuffled nor joined with text."""
    ch, res = gate_tables(spark)
    sha = ch.select(F.col("id").alias("chapter_id"), F.lit("x").alias("src_sha"))
    old = sha.withColumn("src_sha", F.when(F.col("chapter_id") == "a.3", "y").otherwise("x"))
    failed = spark.createDataFrame([("a.2",)], "chapter_id string")
    out = M.merge_chapters(ch, res, old, failed, sha)
    assert rows(out, "id", "merged", "verses_merged", "skipped_nonnull", "captions_merged") == [
        ("a.1", True, 2, 0, 1), ("a.2", False, 0, 0, 0), ("a.3", False, 0, 0, 0)]
    assert [[v.ja for v in r.verses] for r in out.orderBy("id").collect()] == [["本", "本"], [None, None], [None, None]]
    assert not M.merge_chapters(ch, res, old.replace("x", "z"), failed, sha).where("merged").count()
    plan = optimized(out)
    assert "LeftAnti" in plan and "LeftOuter" not in plan
