"""Near-duplicate groups by SimHash over a Gray-order hierarchical index.

A text's fingerprint has one bit per bit of the XXH64 hashes of its word shingles, repeats
included: the bit that more than half of the hashes have set.  Equal fingerprints are one
class.  The classes are sorted by their rank in the reflected Gray code, in which neighbours
differ in one bit, so a run of the order shares most of its bits even where a binary prefix
changes.  Runs of ``BLOCK`` classes are the blocks of the index; ``FAN`` neighbours at a time
get an upper node, level by level, up to one root.  A node knows the bits that all classes
below it have set and those that any of them has set, and so the pattern they share.

The search meets the index with itself.  It starts at the root and replaces a pair of nodes by
the pairs of their children.  A pair carries the bits compared so far and the differences found
in them; only bits that the children share beyond those are compared, and their differences
added up.  A pair whose sum passes the radius is dropped with everything below it.  What is left
are pairs of blocks: one task takes both runs, cuts them into groups with patterns of their own,
goes on in the same way and compares the classes of surviving groups.  No link is lost: shared
bits bound the distance from below.  A batch of block pairs hands on a spanning forest of its
links, so a dense family costs no more rows than it has classes.

Blocks are of one size by exact numbering, whatever is frequent; the tree is never collected or
broadcast; a pair of blocks is the largest thing a task holds.

Defined results: null texts and texts without a word have the fingerprint of zeros and link
like any other; fewer words than the shingle's width are one shingle; rows without an id belong
to the group of their text but do not name it, so the id of a group without any id is null;
repeated rows and ids stay; very long texts are hashed whole, in blocks; an empty table gives
no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import words
from lectern.llm.components import components
from lectern.llm.store import cut
from lectern.operators.ordered import number_sorted

SEED = 42
#: Classes of a block, and of a group inside a block.
BLOCK, GROUP = 1024, 32
#: Two to the power of ``FAN_BITS`` children per upper node.
FAN_BITS = 4
#: Hashes whose bits are counted at once.
AT_ONCE = 65536


def fingerprint(text: str | None, width: int) -> int:
    """The sign bits of the shingles' hashes, as an unsigned number."""
    own = words.words_of(text)
    if not own:
        return 0
    width = min(width, len(own))
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    first = [0, *(ends[: len(own) - width] + 1).tolist()]
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[i:j], SEED) for i, j in zip(first, ends[width - 1 :].tolist())], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        low = hashes[at : at + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(low, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and code, the fingerprint as a signed long, of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = np.array([fingerprint(t, width) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "code": codes})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(run, "doc_id long, code long")


def gray_rank(code: Column) -> Column:
    """Place of a code in the reflected Gray code, as a signed long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(2**63)))


def blocks(codes: DataFrame, size: int = BLOCK) -> DataFrame:
    """node, every, some, codes: runs of ``size`` distinct codes in Gray order.

    ``every`` has the bits set in all codes of the run, ``some`` those set in any.
    """
    placed = number_sorted(codes.select("code", gray_rank(F.col("code")).alias("rank")), [], [F.col("rank")], "at")
    runs = placed.withColumn("node", F.floor((F.col("at") - 1) / size)).groupBy("node").agg(
        F.bit_and("code").alias("every"), F.bit_or("code").alias("some"),
        F.sort_array(F.collect_list(F.struct("at", "code"))).alias("own"))
    return runs.select("node", "every", "some", F.transform("own", lambda x: x["code"]).alias("codes"))


def upper_levels(low: DataFrame, fan_bits: int = FAN_BITS) -> list[DataFrame]:
    """node, every, some of every level, the root's first; ``low`` are the blocks."""
    level = low.select("node", "every", "some")
    out, count = [level], level.count()
    while count > 1:
        level = level.groupBy(F.shiftright("node", fan_bits).alias("node")).agg(
            F.bit_and("every").alias("every"), F.bit_or("some").alias("some"))
        level, count = cut(level, "level"), -(-count >> fan_bits)
        out.append(level)
    return out[::-1]


def _shared(every: str, some: str) -> Column:
    """The bits in which all codes below a node agree."""
    return F.bitwise_not(F.col(every).bitwiseXOR(F.col(some)))


def block_pairs(levels: list[DataFrame], radius: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """a, b, seen, differences: pairs of blocks, a <= b, that may hold codes within the radius.

    ``differences`` are those in the bits ``seen``, which all codes of both blocks share.
    """
    root = levels[0]
    frontier = root.select(F.col("node").alias("a"), F.col("node").alias("b"), _shared("every", "some").alias("seen"), F.lit(0).alias("differences"))
    for level in levels[1:]:
        side = lambda n: level.select(
            F.shiftright("node", fan_bits).alias(n), F.col("node").alias(f"node_{n}"), F.col("every").alias(f"every_{n}"),
            _shared("every", "some").alias(f"shared_{n}"))
        met = frontier.join(side("a"), "a").join(side("b"), "b").where("node_a <= node_b")
        common = F.col("shared_a").bitwiseAND(F.col("shared_b"))
        fresh = common.bitwiseAND(F.bitwise_not("seen"))
        more = F.bit_count(F.col("every_a").bitwiseXOR(F.col("every_b")).bitwiseAND(fresh))
        met = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), common.alias("seen"), (F.col("differences") + more).alias("differences"))
        frontier = cut(met.where(F.col("differences") <= radius), "frontier")
    return frontier


class Run:
    """The codes of a block in groups, with each group's shared pattern."""

    def __init__(self, codes: np.ndarray):
        own = np.asarray(codes, dtype=np.int64).view(np.uint64)
        n = -(-len(own) // GROUP)
        self.codes = np.concatenate([own, np.full(n * GROUP - len(own), own[-1])]).reshape(n, GROUP)
        self.every = np.bitwise_and.reduce(self.codes, axis=1)
        self.shared = ~(self.every ^ np.bitwise_or.reduce(self.codes, axis=1))


def links_of(a: Run, b: Run, seen: int, differences: int, radius: int) -> np.ndarray:
    """Pairs of different codes within the radius, one row each; groups are pruned first."""
    fresh = (a.shared[:, None] & b.shared[None, :]) & ~np.int64(seen).view(np.uint64)
    total = differences + np.bitwise_count((a.every[:, None] ^ b.every[None, :]) & fresh)
    i, j = np.nonzero(total <= radius)
    out = []
    for at in range(0, len(i), 512):
        left, right = a.codes[i[at : at + 512]], b.codes[j[at : at + 512]]
        near = np.bitwise_count(left[:, :, None] ^ right[:, None, :]) <= radius
        p, x, y = np.nonzero(near)
        both = np.stack([left[p, x], right[p, y]], axis=1)
        out.append(both[both[:, 0] != both[:, 1]])
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.uint64)


def forest(links: np.ndarray) -> np.ndarray:
    """Every linked code with the first code of its component among these links."""
    nodes, ends = np.unique(links, return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        # Whoever was the label before follows along.
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[label[moved]]], axis=1)


def near_links(codes: DataFrame, radius: int, size: int = BLOCK, fan_bits: int = FAN_BITS) -> DataFrame:
    """u, v: links that connect exactly the distinct codes that lie within ``radius`` bits of each other, over any steps."""
    spark = codes.sparkSession
    low = cut(blocks(codes, size), "blocks")
    pairs = block_pairs(upper_levels(low, fan_bits), radius, fan_bits)
    side = lambda n: low.select(F.col("node").alias(n), F.col("codes").alias(f"codes_{n}"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").repartition(tasks, "a", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [links_of(Run(x), Run(y), seen, differences, radius) for x, y, seen, differences in
                     zip(batch["codes_a"], batch["codes_b"], batch["seen"], batch["differences"])]
            ends = forest(np.concatenate(found)).view(np.int64) if found else np.zeros((0, 2), dtype=np.int64)
            yield pd.DataFrame({"u": ends[:, 0], "v": ends[:, 1]})

    return both.select("codes_a", "codes_b", "seen", "differences").mapInPandas(run, "u long, v long")


def groups(docs: DataFrame, width: int = 3, radius: int = 2, size: int = BLOCK, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    signed = cut(fingerprints(docs, width), "fingerprints")
    classes = cut(signed.groupBy("code").agg(F.min("doc_id").alias("id")), "classes")
    comps = components(cut(near_links(classes, radius, size, fan_bits), "links"))
    placed = cut(classes.join(comps.select(F.col("node").alias("code"), "component"), "code", "left").select(
        "code", "id", F.coalesce("component", "code").alias("component")), "placed")
    named = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    of_code = placed.join(named, "component").select("code", "component_id")
    text = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return signed.join(of_code, "code").select("doc_id", text.alias("fingerprint"), "component_id")
