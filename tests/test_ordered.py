import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests.compare import rows
from lectern.operators import joins as J
from lectern.operators import ordered as O


def sample(spark, n=400, seed=3):
    rnd = random.Random(seed)
    # One group holds most rows.
    data, used = [], set()
    while len(data) < n:
        g, p = ("hot" if rnd.random() < 0.7 else f"g{rnd.randrange(5)}"), rnd.randrange(5000)
        if (g, p) not in used:
            used.add((g, p))
            data.append((g, p, rnd.choice([None, "a", "b", "c"])))
    return spark.createDataFrame(data, "g string, p int, v string").withColumn("b", F.floor(F.col("p") / 37))


def test_blocked_windows_equal_plain_windows(spark):
    df = sample(spark)
    w = W.partitionBy("g").orderBy("p")
    up = w.rowsBetween(W.unboundedPreceding, 0)
    down = w.rowsBetween(0, W.unboundedFollowing)
    plain = df.select(
        "g", "p", F.row_number().over(w).cast("bigint"), F.last("v", True).over(up), F.first("v", True).over(down),
        F.lag("v").over(w), F.lead("v").over(w),
    )
    order = [F.col("p")]
    out = O.number_rows(df, ["g"], ["b"], order, "n")
    out = O.carry(out, ["g"], "b", order, {"up": F.col("v")})
    out = O.carry(out, ["g"], "b", order, {"down": F.col("v")}, backward=True)
    out = O.neighbours(out, ["g"], "b", order, F.col("v"))
    assert rows(out, "g", "p", "n", "up", "down", "previous", "following") == rows(plain)


def test_same_result_for_any_partitioning(spark):
    df = sample(spark)
    one = O.number_rows(df.repartition(1), ["g"], ["b"], [F.col("p")], "n")
    many = O.number_rows(df.repartition(7, "v"), ["g"], ["b"], [F.col("p")], "n")
    assert rows(one, "g", "p", "n") == rows(many, "g", "p", "n")


RANGES = [(2, 2, "a", "A", 0), (5, 5, "b", "B", 1), (9, 16, "c", "C", 2), (10, 12, "late", "L", 3), (-50, -40, "neg", "N", 4),
          (100, 10**12, "wide", "W", 5), (200, 300, "under", "U", 6), (0, 2**63 - 1, "last", "Z", 7), (8, 3, "empty", "E", -1)]


@pytest.mark.parametrize("few", [4096, 0])
def test_range_assign(spark, monkeypatch, few):
    """Overlapping and huge ranges: the first one wins, whether looked up in the row or carried."""
    monkeypatch.setattr(J, "FEW_PIECES", few)
    ranges = spark.createDataFrame(RANGES, "lo bigint, hi bigint, slug string, title string, position int")
    numbers = [None, -51, -50, -40, -39, -1, 0, 1, 2, 3, 5, 9, 10, 12, 16, 17, 99, 100, 250, 10**12, 10**12 + 1, 2**63 - 2] + [250] * 300
    n = spark.createDataFrame([(x, "kept") for x in numbers], "n bigint, other string")

    def want(x):
        hit = next((r for r in RANGES if x is not None and r[0] <= x <= r[1]), None)
        return (x, hit and hit[2], hit and hit[3], hit and x - hit[0] + 1)

    got = rows(J.assign_ranges(n, "n", ranges), "n", "slug", "title", "ordinal")
    assert got == sorted((want(x) for x in numbers), key=repr)
    assert rows(J.assign_ranges(n, "n", ranges.limit(0)), "slug") == [(None,)] * len(numbers)


def test_asof(spark):
    anchors = spark.createDataFrame([("p", 0, "v1"), ("p", 10, "v2"), ("p", 25, "v3"), ("q", 50, "w")], "page string, location bigint, anchor string")
    hits = spark.createDataFrame([("p", 12, 0), ("p", 26, 1), ("p", 27, 2), ("p", 3, 3), ("q", 4, 0)], "page string, location bigint, hit_no bigint")
    matched = J.asof_anchors(hits, anchors, ["page"], block=7)
    first = J.distinct_in_hit_order(matched, ["page"]).orderBy("first_hit")
    assert [r.anchor for r in first.collect()] == ["v2", "v3", "v1"]


def test_coverage(spark):
    def side(ids):
        return spark.createDataFrame([("c", i, o) for o, i in enumerate(ids, 1)], "chapter_id string, verse_id string, ord int")

    want = side(["1", "2", "3"])

    def status(ids):
        return {r.verse_id: r.status for r in J.coverage_diff(want, side(ids), "chapter_id", "verse_id").collect() if r.status != "ok"}

    def moved(ids):
        return J.order_mismatch(want, side(ids), "chapter_id", "verse_id").head().n_different

    assert status(["1", "3", "2"]) == {} and moved(["1", "3", "2"]) == 2
    assert status(["1", "2"]) == {"3": "missing"}
    assert status(["1", "2", "2", "4"]) == {"3": "missing", "2": "duplicate", "4": "extra"}
    assert moved(["1", "2", "3"]) == 0


def test_number_sorted_spreads_any_order(spark):
    """Distinct scores, one shared prefix, ties with a unique last column, and null groups."""
    data = [(g, f"prefix shared by all {(k * 7919) % 500:05d}", k) for g in ("a", None, "b") for k in range(500 if g == "a" else 3)]
    df = spark.createDataFrame(data, "g string, s string, k long").repartition(5)
    got = rows(O.number_sorted(df, ["g"], [F.col("s").desc(), F.col("k")], "n"))
    want = []
    for g in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == g), key=lambda d: ([-ord(c) for c in d[1]], d[2]))
        want += [(*d, n) for n, d in enumerate(own, 1)]
    assert got == sorted(want, key=repr)
    same = spark.range(1000).select(F.lit(1.5).alias("score"), "id")
    numbered = O.number_sorted(same, [], [F.col("score"), F.col("id")], "n")
    assert numbered.where("n <> id + 1").count() == 0 and numbered.count() == 1000
    assert O.number_sorted(same.limit(0), [], [F.col("id")]).count() == 0
