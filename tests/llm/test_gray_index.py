"""The Gray-order index against comparing all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import gray_index, queries
from lectern.llm.components import components
from lectern.llm.store import read
from tests.llm import brute

SF = "/root/testdata/sf0.001"
RNG = random.Random(11)
SIGN = 1 << 63


def signed(x):
    return x - 2 * SIGN if x >= SIGN else x


def near_codes(n):
    """Chains and balls of codes that differ in few bits, among codes far from all others."""
    out = [0, 2**64 - 1]
    while len(out) < n:
        base = out[-1] if RNG.random() < 0.6 else RNG.getrandbits(64)
        for _ in range(RNG.randrange(4)):
            base ^= 1 << RNG.randrange(64)
        out.append(base)
    return out


@pytest.mark.parametrize("radius, size, fan_bits", [(0, 8, 1), (2, 8, 2), (3, 50, 4), (2, 1024, 4)])
def test_no_link_is_lost(spark, radius, size, fan_bits):
    codes = sorted(set(near_codes(400)))
    df = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    got = {r.node: r.component for r in components(gray_index.near_links(df, radius, size, fan_bits)).collect()}
    groups = {}
    for c in codes:
        groups.setdefault(got.get(signed(c), signed(c)), set()).add(c)
    want = {}
    for c, top in brute.linked(codes, radius).items():
        want.setdefault(top, set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_far_groups_are_pruned(spark):
    codes = [(signed(RNG.getrandbits(8) * 0x10101 << 40 | RNG.getrandbits(20)),) for _ in range(3000)]  # bytes differ in three bits at least
    low = gray_index.blocks(spark.createDataFrame(codes, "code long").distinct(), 16).cache()
    n = low.count()
    pairs = gray_index.block_pairs(gray_index.upper_levels(low, 2), 2, 2)
    assert n <= pairs.count() < n * n / 10
    sizes = [len(r.codes) for r in low.collect()]
    assert sorted(sizes)[1:] == [16] * (n - 1)


def test_gray_neighbours_differ_in_one_bit(spark):
    code = F.shiftleft("id", 56)
    df = spark.range(256).select(code.alias("code"), gray_index.gray_rank(code).alias("rank"))
    codes = [r.code % 2**64 for r in df.orderBy("rank").collect()]
    assert all((a ^ b).bit_count() == 1 for a, b in zip(codes, codes[1:]))


def test_forest_connects_what_links_connect():
    for _ in range(50):
        n = RNG.randrange(1, 60)
        links = np.array([(RNG.randrange(n), RNG.randrange(n)) for _ in range(RNG.randrange(1, 80))], dtype=np.uint64)

        def classes(edges):
            root = list(range(n))
            for u, v in edges:
                a, b = root[int(u)], root[int(v)]
                root = [min(a, b) if r in (a, b) else r for r in root]
            return root

        assert classes(gray_index.forest(links)) == classes(links) and len(gray_index.forest(links)) < n
    assert len(gray_index.forest(np.zeros((0, 2), dtype=np.uint64))) == 0


def want_groups(rows, width, radius):
    code = {t: brute.simhash64(t, width) for t in {t for _, t in rows}}
    top = brute.linked(code.values(), radius)
    least = {}
    for i, t in rows:
        if i is not None:
            least[top[code[t]]] = min(i, least.get(top[code[t]], i))
    return sorted(((i, f"{code[t]:016x}", least.get(top[code[t]])) for i, t in rows), key=repr)


@pytest.mark.parametrize("width, radius", [(3, 2), (1, 4)])
def test_groups_of_odd_rows(spark, width, radius):
    prose = " ".join(RNG.choice("alpha Beta gamma delta éclair straße Zeta eta theta".split()) for _ in range(400))
    rows = [(1, prose), (2, prose), (2, prose), (3, None), (4, ""), (5, " \n\t\x0b "), (6, "One."), (7, "ONE."), (8, "two words"), (None, prose),
            (None, "only without id"), (9, "word " * 70_000), (10, prose + " tail"), (11, "a b c"), (12, "a b c d"), (13, "É é"), (14, prose.upper())]
    rows += [(20 + k, prose.replace("Beta", "beta2", k)) for k in range(12)]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, code int, node string")
    got = sorted((tuple(r) for r in gray_index.groups(df, width, radius, 4, 1).collect()), key=repr)
    assert got == want_groups(rows, width, radius)
    assert gray_index.groups(df.limit(0), width, radius).count() == 0


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    got = sorted((tuple(r) for r in queries.op11(spark, SF).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == want_groups(rows, 3, 2)
