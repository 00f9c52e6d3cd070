import random
import re

from pyspark.sql import functions as F

from tests.compare import rows
from lectern.operators import quality as K
from lectern.operators import terms as T


def dictionary(spark, items):
    """(slug, term, forms, zh_hant, zh_hans, ja) rows."""
    return spark.createDataFrame(
        [(s, t, f, (a, b, c), i) for i, (s, t, f, a, b, c) in enumerate(items)],
        "slug string, term string, source_forms array<string>, "
        "translit struct<zh_hant:string,zh_hans:string,ja:string>, position int")


def verses(spark, texts):
    return spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "chapter_id string, ord int, en string")


KEYS = ["chapter_id", "ord"]


def test_three_rules_stay_apart(spark):
    terms = dictionary(spark, [("ben", "Ben", None, "本", "本", "ベン"), ("oc", "Orian chiefs", [], None, None, None)])
    v = verses(spark, ["been", "Ben-hur", "Ben, son", "Orian Chiefs", "chiefs Orian", "Orian the chiefs"])
    assert rows(T.token_edges(v, "en", KEYS, T.term_forms(terms)), "ord", "slug") == [(2, "ben"), (3, "oc")]
    assert rows(T.word_edges(v, "en", KEYS, terms), "ord", "slug") == [(1, "ben"), (2, "ben"), (3, "oc")]


def test_word_rule_equals_python(spark):
    names = ["Ben", "O'Neil", "a.b", "c++", "x-ray", "É", "the end", "(z)", "…", "-", "ß"]
    terms = dictionary(spark, [(str(i), n, None, None, None, None) for i, n in enumerate(names)])
    rnd = random.Random(5)
    words = names + ["ben", "been", "O'NEIL's", "aXb", "c", "ray", "é", "the", "end", "z", ",", "q…q", "a-b"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "", "-", ", "]) for _ in range(8)) for _ in range(150)]
    want = sorted(
        (i, str(j)) for i, t in enumerate(texts) for j, n in enumerate(names)
        if re.search(r"\b" + re.escape(n) + r"\b", t, re.I))
    got = sorted((r.ord, r.slug) for r in T.word_edges(verses(spark, texts), "en", KEYS, terms).collect())
    assert got == want and want


def test_token_rule_equals_brute_force(spark):
    rnd = random.Random(7)
    alphabet = ["a", "b", "c", "d'e", "f-g"]
    forms = [" ".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 3))) for _ in range(12)]
    terms = dictionary(spark, [(str(i), f, None, None, None, None) for i, f in enumerate(forms)])
    texts = [" ".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 7))) for _ in range(60)]
    want = sorted((i, str(j)) for i, t in enumerate(texts) for j, f in enumerate(forms) if f" {f} " in f" {t} ")
    got = sorted((r.ord, r.slug) for r in T.token_edges(verses(spark, texts), "en", KEYS, T.term_forms(terms)).collect())
    assert got == want and want


def test_large_dictionary_takes_the_shuffle_path(spark, monkeypatch):
    monkeypatch.setattr(T, "small_side", lambda df, max_rows=0: df)
    terms = dictionary(spark, [("ben", "Ben", None, "本", "本", "ベン")])
    v = verses(spark, ["Ben", "no"])
    assert rows(T.token_edges(v, "en", KEYS, T.term_forms(terms)), "ord") == [(0,)]
    assert rows(T.word_edges(v, "en", KEYS, terms), "ord") == [(0,)]


def test_presence(spark):
    df = spark.createDataFrame(
        [("Corpor", "corporeal"), ("Ben", "been"), ("Ben", ""), ("Ben", None), ("Ben", "Ben-hur")], "t string, e string")
    got = [r.p for r in df.select(T.english_present(F.col("t"), F.col("e")).alias("p")).collect()]
    assert got == [True, False, True, True, True]


def test_annotate_longest_first(spark):
    terms = dictionary(spark, [("s1", "t1", None, "AB", None, None), ("s2", "t2", None, "ABC", None, None), ("s3", "Q\\E.", None, "Z", None, None)])
    v = spark.createDataFrame([("c", 0, "t1 t2", "ABCAB"), ("c", 1, "T1", "xABx"), ("c", 2, "none", "AB")], "chapter_id string, ord int, en string, zh_hant string")
    tags = spark.createDataFrame([("c", 0, "t1", 0), ("c", 0, "t2", 1), ("c", 1, "T1", 0), ("c", 2, "t1", 0)], "chapter_id string, ord int, tag string, tag_no int")
    out = T.annotate(v, tags, terms, "zh_hant", KEYS)
    assert rows(out, "ord", "annotated") == [(0, "ABC（t2）AB（t1）"), (1, "xAB（t1）x"), (2, "AB")]


def test_annotate_equals_scan(spark):
    rnd = random.Random(11)
    items = [(f"s{i}", f"word{i}", None, "".join(rnd.choice("甲乙丙") for _ in range(rnd.randint(1, 3))), None, None) for i in range(6)]
    terms = dictionary(spark, items)
    english = " ".join(i[1] for i in items)
    texts = ["".join(rnd.choice("甲乙丙丁") for _ in range(12)) for _ in range(30)]
    v = spark.createDataFrame([("c", i, english, t) for i, t in enumerate(texts)], "chapter_id string, ord int, en string, zh_hant string")
    tags = spark.createDataFrame([("c", i, it[1], k) for i in range(30) for k, it in enumerate(items)], "chapter_id string, ord int, tag string, tag_no int")
    pairs = sorted(((it[3], it[1]) for it in items), key=lambda p: -len(p[0]))

    def scan(text):
        out, i = "", 0
        while i < len(text):
            hit = next((p for p in pairs if text.startswith(p[0], i)), None)
            out += f"{hit[0]}（{hit[1]}）" if hit else text[i]
            i += len(hit[0]) if hit else 1
        return out

    got = [r.annotated for r in T.annotate(v, tags, terms, "zh_hant", KEYS).orderBy("ord").collect()]
    assert got == [scan(t) for t in texts]


def test_resolve_tags(spark):
    terms = dictionary(spark, [("a", "Dan", None, *[None] * 3), ("b", "dan", None, *[None] * 3), ("c", "Es", None, *[None] * 3)])
    tags = spark.createDataFrame([("Dan",), ("DAN",), ("es",), ("no",)], "tag string")
    assert rows(T.resolve_tags(tags, "tag", terms), "tag", "slug") == [("DAN", "b"), ("Dan", "a"), ("es", "c")]


def test_renderings_are_substrings(spark):
    terms = dictionary(spark, [("a", "A", None, "甲", None, None), ("b", "B", None, None, "乙丙", None), ("c", "C", None, None, None, "エセ界")])
    t = spark.createDataFrame([("x", "這甲乙丙"), ("y", "エセ界"), ("z", "乙")], "chapter_id string, text string")
    assert rows(T.rendering_edges(t, "text", ["chapter_id"], terms), "chapter_id", "slug") == [("x", "a"), ("x", "b"), ("y", "c")]


def test_lock_check(spark):
    terms = dictionary(spark, [("ben", "Ben", None, "本", "本", "ベン")])
    rec = spark.createDataFrame([("c", "verse 1", "Ben came", "本來", "本来", "きた"), ("c", "verse 2", "been", "", "", "")],
                                "chapter_id string, label string, en string, zh_hant string, zh_hans string, ja string")
    assert rows(K.check_locks(rec, terms, T.term_forms(terms)), "id", "detail") == [("verse 1", "ja missing Ben→ベン")]


def test_backlinks_of_a_hot_term_stay_whole(spark):
    edges = spark.createDataFrame([("hot", 1, c, o, f"b.{c}.{o}") for c in range(60) for o in range(1, 51)],
                                  "slug string, book_position int, chapter bigint, ord int, verse_id string")
    terms = dictionary(spark, [("hot", "h", None, *[None] * 3), ("cold", "c", None, *[None] * 3)])
    parts = T.backlinks(edges, terms, part=700).orderBy("slug", "part_no").collect()
    assert [p.slug for p in parts] == ["cold"] + ["hot"] * 5 and parts[0].verse_ids == []
    assert sum((p.verse_ids for p in parts[1:]), []) == [f"b.{c}.{o}" for c in range(60) for o in range(1, 51)]
    shown = {r.slug: r.appears for r in T.backlink_summary(edges, terms).collect()}
    assert shown["cold"] == "" and shown["hot"].endswith("… (+2988)") and shown["hot"].startswith("b.0.1, b.0.2")


def test_rendering_rule_equals_brute_force(spark, monkeypatch):
    """Renderings of one character up, overlapping and prefixes of each other, probed or joined by windows."""
    rnd = random.Random(9)
    parts = ["以", "太", "界", "a", "ab", "𠀀", "é", "x y"]
    forms = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5))) for _ in range(25)})
    terms = dictionary(spark, [(str(i), f"t{i}", None, r, None, "" if i % 2 else None) for i, r in enumerate(forms)])
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(80)] + [None, ""]
    want = sorted((i, str(j)) for i, t in enumerate(texts) for j, r in enumerate(forms) if t and r in t)
    for most in (T.MOST_ENTRIES, 3):
        monkeypatch.setattr(T, "MOST_ENTRIES", most)
        got = sorted((r.ord, r.slug) for r in T.rendering_edges(verses(spark, texts), "en", KEYS, terms).collect())
        assert got == want and want
    assert T.rendering_edges(verses(spark, texts), "en", KEYS, terms.limit(0)).count() == 0


def test_only_matches_leave_the_row(spark):
    """Neither n-grams nor texts are unnested where nothing matches."""
    terms = dictionary(spark, [("ben", "Ben Nevis", None, "本", "本", "ベン")])
    v = verses(spark, ["one two three four five six seven eight nine ten"] * 50 + ["on Ben Nevis"])
    for edges in (T.token_edges(v, "en", KEYS, T.term_forms(terms)), T.word_edges(v, "en", KEYS, terms)):
        assert rows(edges, "ord") == [(50,)]
        plan = edges._jdf.queryExecution().executedPlan()
        assert "Generate" in plan.toString()
    from lectern.functions.probe import Probe, probe_of

    known = probe_of(spark.createDataFrame([(w,) for w in "abcdef"], "w string"), "w")
    df = spark.createDataFrame([(chr(97 + i),) for i in range(26)] + [("é",), (None,)], "w string")
    passed = {r.w for r in df.where(known(F.col("w"))).collect()}
    assert set("abcdef") <= passed and len(passed) <= 7
    assert df.where(Probe(None)(F.col("w"))).count() == 28


def test_listed_numbers(spark):
    from lectern.functions.probe import listed

    filed = {f"k{i}": [i, 1000 + i] for i in range(300)}
    lookup = listed(spark, filed)
    df = spark.createDataFrame([(k,) for k in [*filed, "other", "k300"]], "k string")
    got = {r.k: r.n for r in df.select("k", lookup(F.col("k")).alias("n")).collect()}
    assert all(set(own) <= set(got[k]) for k, own in filed.items())
    assert sum(len(n) for n in got.values()) < 900


def test_stored_index_and_top_hits(spark, tmp_path):
    from lectern.operators import search as Q

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    # One word stands in every verse, one chapter block holds the best hits.
    data = [(f"b.{c}", c, o, " ".join(["hot", *(rnd.choice(words) for _ in range(rnd.randrange(12))), *["w1"] * (c % 7 == 0) * 5]))
            for c in range(0, 60_000, 500) for o in range(3)]
    v = spark.createDataFrame(data, "chapter_id string, chapter int, ord int, en string")
    queries = spark.createDataFrame([("q1", "hot w1"), ("q2", "w2 w3"), ("q3", "none here"), ("q4", "hot")], "query_id string, query string")
    # Tokens are letters only, so write the numbers as letters.
    letters = F.translate("en", "0123456789", "abcdefghij")
    v, queries = v.withColumn("en", letters), queries.withColumn("query", F.translate("query", "0123456789", "abcdefghij"))
    keys, root = ["chapter_id", "chapter", "ord"], str(tmp_path / "index")
    index = Q.build_index(v, "en", keys)
    assert index.agg(F.sum("tf")).head()[0] == sum(len(r.en.split()) for r in v.collect())
    Q.write_index(index, root, 8)
    postings, blocks = Q.read_index(spark, root, Q.query_tokens(queries), 8)
    full = Q.search(index, queries, keys)
    stored = Q.search(postings.drop("block"), queries, keys, frequency=Q.frequencies(blocks))
    assert rows(stored, "query_id", "chapter", "ord", "score") == rows(full, "query_id", "chapter", "ord", "score")
    best = {}
    for r in full.collect():
        best.setdefault(r.query_id, []).append((-r.score, r.chapter, r.ord))
    want = sorted((q, -s, c, o, n) for q, own in best.items() for n, (s, c, o) in enumerate(sorted(own)[:5], 1))
    got = sorted((r.query_id, r.score, r.chapter, r.ord, r["rank"]) for r in Q.top_hits(postings, blocks, queries, 5, 1).collect())
    assert got == want and {q for q, *_ in got} == {"q1", "q2", "q4"}


def test_stored_index_moves_each_posting_once(spark, tmp_path):
    import re

    from lectern.operators import search as Q

    # Several queries share a word; every split holds chapters of its own.
    data = [(f"b.{c}", c, o, f"hot w{'abc'[(c + o) % 3]}") for c in range(0, 30_000, 100) for o in range(2)]
    v = spark.createDataFrame(data, "chapter_id string, chapter int, ord int, en string").repartitionByRange(3, "chapter")
    queries = spark.createDataFrame([("q1", "hot wa"), ("q2", "hot wb"), ("q3", "hot wc"), ("q4", "hot")], "query_id string, query string")
    keys, root = ["chapter_id", "chapter", "ord"], str(tmp_path / "index")
    index = Q.build_index(v, "en", keys)
    Q.write_index(index, root, 4)
    spans = {}
    for r in spark.read.parquet(f"{root}/postings").select("chapter", F.input_file_name().alias("f")).collect():
        spans.setdefault(re.search(r"part-(\d+)", r.f)[1], set()).add(r.chapter)
    # A file holds postings of one split only: none of them was shuffled.
    assert len(spans) == 3 and sum(len(own) for own in spans.values()) == 300
    postings, blocks = Q.read_index(spark, root, Q.query_tokens(queries), 4)
    assert postings.count() == index.count() == 1200
    top = Q.top_hits(postings, blocks, queries, 3, 1)
    # Postings are not shuffled once for every query that asks for their word.
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, chapter_id", top._jdf.queryExecution().executedPlan().toString())
    best = {}
    for r in Q.search(index, queries, keys).collect():
        best.setdefault(r.query_id, []).append((-r.score, r.chapter, r.ord))
    want = sorted((q, -s, c, o, n) for q, own in best.items() for n, (s, c, o) in enumerate(sorted(own)[:3], 1))
    assert sorted((r.query_id, r.score, r.chapter, r.ord, r["rank"]) for r in top.collect()) == want and len(want) == 12


def test_records_and_scope_text(spark):
    from lectern import schemas
    from lectern.operators import corpus as C

    cap = ("Cap", "圖", None, None)
    vs = [("a.1.1", 1, "one", None, "一", None, [], None, [], [("s", "1", cap), ("t", "1", None)]), ("a.1.2", 2, "two", None, None, None, [], None, [], None)]
    ch = spark.createDataFrame([("a.1", "a", 1, "A", ("pre", None, None, "序"), None, vs)], schemas.CHAPTER)
    assert rows(C.records_of(ch), "label", "en", "ja") == [("caption a.1.1#0", "Cap", None), ("preamble", "pre", "序"), ("verse 1", "one", None), ("verse 2", "two", None)]
    text = ch.select(C.text_of(ch, ["en"]).alias("a"), C.text_of(ch, ["en"], lambda v: v["verse_number"] == 2).alias("b"),
                     C.text_of(ch, ["zh_hant", "zh_hans", "ja"]).alias("c")).head()
    assert tuple(text) == ("pre\none\nCap\ntwo", "pre\ntwo", "序\n一\n圖")


def test_tree_pattern_takes_the_longest_entry():
    import random
    import re

    from lectern.functions.probe import starts_of, tree_pattern

    rng = random.Random(3)
    entries = sorted({"".join(rng.choices("abcdefghij. 譯", k=rng.randint(1, 4))) for _ in range(150)})
    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), tree_pattern(entries)))
    for _ in range(300):
        text = "".join(rng.choices("abcdefghij. 譯", k=8))
        here = [e for e in entries if text.startswith(e)]
        found = pattern.match(text)
        assert (found and found[0]) == (max(here, key=len) if here else None)
        if here:
            assert sorted(e for whole, e in starts_of(entries) if whole == found[0]) == sorted(here)


def test_words_and_renderings_are_found_by_one_pattern(spark):
    """Terms that start with each other, in any case; no step per word or place of the text."""
    texts = ["The Lord GOD's god-son, ΟΔΟΣ'α Οδος straße.", "Lords of the lord of", "STRASSE x.y xzy X.Y", None, ""]
    records = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    names = ["lord", "Lord of", "lord of the", "god", "god-son", "οδος", "straße", "x.y", "'s"]
    kind = "slug string, term string, translit struct<zh_hant:string,zh_hans:string,ja:string>"
    terms = spark.createDataFrame([(n, n, (n[:1], n[:2], None)) for n in names], kind)
    words = T.word_edges(records, "text", ["id"], terms)
    # The term's own pattern over whole texts.
    every = records.crossJoin(terms).where(F.rlike("text", T.word_pattern(F.col("term")))).select("id", "slug")
    assert rows(words, "id", "slug") == rows(every) and words.count() == 9
    found = T.rendering_edges(records, "text", ["id"], terms)
    assert rows(found, "id", "slug") == sorted(
        {(i, n) for i, t in enumerate(texts) for n in names if t and (n[:1] in t or n[:2] in t)}, key=repr)
    words = T.word_edges(records, "text", ["id"], terms.where("slug like '_o%'"))
    plan = words._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_token_runs_are_found_by_one_pattern(spark):
    """Against a plain search in the tokens; no probe per word of the text."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("ab'-é", k=rng.randint(1, 3)))
    texts = [rng.choice([" ", ", ", "' ", " -", "--", "\n", "9"]).join(word() for _ in range(rng.randint(0, 12))) for _ in range(400)]
    names = sorted({" ".join(rng.choice(["a", "b", "ab", "a-b", "b'a", "ba"]) for _ in range(rng.randint(1, 3))) for _ in range(40)})
    cut = lambda t: re.findall("[a-z]+(?:['-][a-z]+)*", t)
    terms = dictionary(spark, [(n, n, None, *[None] * 3) for n in names])
    edges = T.token_edges(verses(spark, [*texts, None]), "en", KEYS, T.term_forms(terms))
    want = {(i, n) for i, t in enumerate(texts) for n in names if f" {n} " in f" {' '.join(cut(t))} "}
    assert set(rows(edges, "ord", "slug")) == want and len(want) > 300
    assert "xxhash64" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_tags_of_a_verse_meet_it_once(spark):
    """English is judged in the verse's row, so its text is not joined a second time."""
    terms = dictionary(spark, [("a", "Abel", None, None, "甲", None), ("b", "Bees", None, None, "甲乙", None), ("c", "Cain", None, None, "丙", None)])
    text = verses(spark, ["Abel bees", "cain", "none", None]).withColumn("zh_hans", F.lit("甲乙甲丙"))
    tagged = spark.createDataFrame(
        [("c", i, t, n) for i in range(4) for n, t in enumerate(["Abel", "Bees", "Cain"])], "chapter_id string, ord int, tag string, tag_no int")
    out = T.annotate(text, tagged, terms, "zh_hans", KEYS)
    assert rows(out, "ord", "annotated") == [
        (0, "甲乙（Bees）甲（Abel）丙"), (1, "甲乙甲丙（Cain）"), (2, "甲乙甲丙"), (3, "甲乙（Bees）甲（Abel）丙（Cain）")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"LogicalRDD \[chapter_id#\d+, ord#\d+, en#", plan)) == 1
