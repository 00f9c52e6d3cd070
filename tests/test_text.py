import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.unicode import normalise


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_collapse(spark):
    got = apply(spark, ["the king p. 10 said", "chap. 3 ends", "a  b", " x \n y "], X.collapse)
    assert got == ["the king said", "chap. 3 ends", "a b", "x y"]


def test_parse_verse(spark):
    got = apply(spark, ["12. Then  came", "12.Then", "7.", "3. x p. 4 y"], X.parse_verse)
    assert [tuple(r) for r in got] == [(True, 12, "Then came"), (False, None, ""), (False, None, ""), (True, 3, "x y")]


def test_split_anchor_keeps_case(spark):
    got = apply(spark, ["l4thb1", "LFthB7", "BGW30", "aph"], X.split_anchor)
    assert [tuple(r) for r in got] == [("l4thb", 1), ("LFthB", 7), ("BGW", 30), (None, None)]


def test_sha16(spark):
    assert apply(spark, [None, "", "Jah"], X.sha16) == ["e3b0c44298fc1c14", "e3b0c44298fc1c14", "c5c8b91a3aca2123"]


def test_tokenize(spark):
    got = apply(spark, ["Es’enaurs, the Lords' I'hins well-known 3rd", "Straße", None, "ﬁne Café"], X.tokenize)
    assert got == [["es'enaurs", "the", "lords", "i'hins", "well-known", "rd"], ["strasse"], [], ["fine", "caf"]]


def test_title_from_slug(spark):
    assert apply(spark, ["lords-first", "2nd-book", "arc-of-bon"], X.title_from_slug) == [
        "Lords First", "2Nd Book", "Arc Of Bon"]
    assert [s.replace("-", " ").title() for s in ["2nd-book"]] == ["2Nd Book"]


def test_pct(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (2, 3)], "n int, t int")
    assert [r.p for r in df.select(X.pct(F.col("n"), F.col("t")).alias("p")).collect()] == [
        "1/3 (33%)", "0/0 (0%)", "2/3 (66%)"]


def test_i18n_normalise(spark):
    got = apply(spark, ['{"en":"a","ja":"b"}', '"old"', "null", None], X.i18n_normalise)
    assert [tuple(r) for r in got] == [("a", None, None, "b"), ("old", None, None, None), ("", None, None, None), ("", None, None, None)]


def test_agent_json(spark):
    got = apply(spark, ['```json\n{"a":1}\n```', 'sure {"a":{"b":2}} ok', "none"], X.clean_agent_json)
    assert got == ['{"a":1}', '{"a":{"b":2}}', None]


def test_overflow_list(spark):
    df = spark.createDataFrame([([str(i) for i in range(14)],), (["a", "b"],)], "x array<string>")
    got = [r.y for r in df.select(X.overflow_list(F.col("x")).alias("y")).collect()]
    assert got == [", ".join(map(str, range(12))) + " … (+2)", "a, b"]


def test_null_field_digest(spark):
    full, part = ("a", "b", "c"), ("a", "", None)
    df = spark.createDataFrame(
        [(full, "d", full, ("n", *full)), (part, " ", part, ("n", *full)), (full, "d", part, ("n", *part))],
        "t struct<zh_hant:string,zh_hans:string,ja:string>, s string, "
        "l struct<zh_hant:string,zh_hans:string,ja:string>, n struct<en:string,zh_hant:string,zh_hans:string,ja:string>",
    )
    got = [r.y for r in df.select(X.null_field_digest(*[F.col(c) for c in "tsln"]).alias("y")).collect()]
    assert got == ["none", "translit", "def,note"]


def fold(text):
    text = unicodedata.normalize("NFC", text or "").replace("’", "'").replace("ʼ", "'")
    return text.casefold()


@pytest.mark.parametrize("seed", [0])
def test_normalise_equals_python(spark, seed):
    marks = ["Å", "Å", "Σίσυφος ΣΑΣ", "ŉ", "ǰ", "İstanbul", "ﬃ", "ẞ", "µ", "ſ", "K", "ﾊﾞ", "각", "각", "é’s", "𐐀", "Ⅷ", "ͅx"]
    assert apply(spark, marks, normalise) == [fold(m) for m in marks]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=12).filter(lambda s: not re.search("[\ud800-\udfff]", s)), min_size=40, max_size=60))
def test_normalise_random(spark, texts):
    assert apply(spark, texts, normalise) == [fold(t) for t in texts]


def test_index_counts_tokens_by_patterns(spark):
    """Counts, asked words and character pairs, as plain Python has them; no step per token."""
    import re
    from collections import Counter

    from lectern.functions.unicode import slow_path_pattern
    from lectern.operators import search as Q

    token = re.compile("[a-z]+(?:['-][a-z]+)*")
    texts = ["The the cat's cat-nap, a-'b a'b a ab AB ’tis", "b--a'b'c' ab- -ab cat's", "", None, "譯文本 ア the x譯y 𠀀𠀁文"]
    records = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    counts = {(t, i): n for i, x in enumerate(texts) for t, n in Counter(token.findall((x or "").lower().replace("’", "'"))).items()}
    every = Q.build_index(records, "text", ["id"])
    assert {(r.token, r.id): r.tf for r in every.collect()} == counts
    asked = spark.createDataFrame([(w,) for w in ("a", "ab", "a'b", "cat", "cat's", "the", "-", "zz")], "token string")
    some = Q.build_index(records, "text", ["id"], only=asked)
    assert {(r.token, r.id): r.tf for r in some.collect()} == {k: n for k, n in counts.items() if k[0] in ("a", "ab", "a'b", "cat", "cat's", "the")}
    assert records.where("id = 4").select(Q.cjk_bigrams(F.col("text")).alias("p")).first().p == ["譯文", "文本", "ア", "譯", "𠀀𠀁", "𠀁文"]
    plan = every._jdf.queryExecution().optimizedPlan().toString() + some._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "[^" not in slow_path_pattern()
