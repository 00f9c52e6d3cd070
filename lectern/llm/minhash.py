"""Near-duplicate groups by MinHash with tensored banding and exact confirmation.

Two small collections of bands, ``SIDE`` each, of ``WIDTH`` minima per band, are computed.
A table is a pair of bands, one of each collection, so ``SIDE`` squared tables with keys of
``2 * WIDTH`` minima cost only ``2 * SIDE * WIDTH`` minima.  At a similarity of 0.8 a pair
shares no table with probability 7e-5.

Documents with equal shingle sets are one class.  Each class meets the smallest leader of
its buckets, a leader being a bucket's smallest class; what is linked after confirmation
forms components.  Then it meets one leader of each other component in its buckets.  At
last, in buckets that still hold several components, classes of different components meet,
so no pair that shares a bucket is left unseen, while a group of near copies never expands
into all its pairs.  Before the texts are fetched, a pair is dropped if its sizes or the parity
bitmaps of its sets prove it below the threshold, or if fewer than ``AGREE`` of its
``2 * SIDE * WIDTH`` minima agree (at 0.8 that loses 2 in 100,000).  Links are confirmed on
the full sets of shingles.

Defined results: null texts and texts without a word have no shingles and link with nothing;
fewer words than the shingle's width are one shingle; an id that occurs with several texts
stands for all of them; rows without an id are linked with nothing and kept; repeated rows
stay; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.llm import words
from lectern.llm.components import components
from lectern.llm.store import cut

SIDE, WIDTH = 10, 2
MINIMA = 2 * SIDE * WIDTH
AGREE = 21
#: Longs of a class's parity bitmap: each shingle flips one bit.
PARITY = 32
#: Tables of ids up to this many rows (8 bytes each) are broadcast, larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_RNG = np.random.default_rng(20)
_MULT = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set; long sets in blocks."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 32768):
        block = (shingles[None, at : at + 32768] ^ _FLIP[:, None]) * _MULT[:, None]
        out = np.minimum(out, block.min(axis=1))
    return out


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bitmap in which every shingle flips one bit."""
    flips = np.bincount((shingles & np.uint64(PARITY * 64 - 1)).astype(np.int64), minlength=PARITY * 64) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key, a, b, sketch, parity of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = words.WordHash()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                own = np.unique(words.shingles(words.hashes(words.words_of(text), known), width))
                if not len(own):
                    rows.append((doc_id, 0, None, None, None, None, None))
                    continue
                low = minima(own)
                bands = words.mix(words.mix(low[0::WIDTH]) + low[1::WIDTH] * np.uint64(3)).view(np.int64)
                rows.append((doc_id, len(own), xxhash.xxh3_128_hexdigest(own.tobytes()), bands[:SIDE], bands[SIDE:],
                             low.astype(np.uint16).tobytes(), parity(own)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_key", "a", "b", "sketch", "parity"])
            yield out.astype({"doc_id": "Int64"})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(
        run, "doc_id long, n_shingles long, set_key string, a array<long>, b array<long>, sketch binary, parity array<long>")


def buckets(classes: DataFrame) -> DataFrame:
    """key, node, leader: the tables' buckets that hold more than one class."""
    keys = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(i, j, x, y))))
    entries = classes.select("node", F.explode(keys).alias("key"))
    same = W.partitionBy("key")
    met = entries.withColumn("leader", F.min("node").over(same)).withColumn("last", F.max("node").over(same))
    return met.where("leader < last").select("key", "node", "leader")


def _agree(a: str, b: str):
    """Number of equal minima of two sketches."""
    part = lambda c, k: F.substring(c, k * 2 + 1, 2)
    return sum((F.when(part(a, k) == part(b, k), 1).otherwise(0) for k in range(MINIMA)), F.lit(0))


def _room(size_u: str, size_v: str, parity_u: str, parity_v: str, percent: int):
    """Do sizes and parities leave room for the threshold?  Never false for a link.

    Every bit in which two parities differ needs a shingle that only one side has, so the
    differing bits bound the intersection from above.
    """
    differ = sum((F.bit_count(F.get(parity_u, F.lit(k)).bitwiseXOR(F.get(parity_v, F.lit(k)))) for k in range(PARITY)), F.lit(0))
    both = F.col(size_u) + F.col(size_v)
    # 100 * common >= percent * (both - common), with common at most half of what does not differ
    return (100 * F.least(size_u, size_v) >= percent * F.greatest(size_u, size_v)) & (
        (100 + percent) * F.shiftright(both - differ, 1) >= percent * both)


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of classes whose sizes and minima leave room for the threshold."""
    side = lambda n: classes.select(
        F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("n_shingles", "sketch", "parity")])
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    room = _room("n_shingles_u", "n_shingles_v", "parity_u", "parity_v", percent)
    return both.where(room & (_agree("sketch_u", "sketch_v") >= AGREE)).select("u", "v")


def shingle_set(text: str | None, width: int) -> frozenset:
    own = words.words_of(text)
    width = min(width, len(own))
    return frozenset(zip(*(own[k:] for k in range(width)))) if width else frozenset()


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the threshold.

    Only texts that occur in a pair are moved.  Their ids are broadcast up to a checked
    number; beyond it they are joined by shuffle.
    """
    ids = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    ids = cut(ids, "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v").join(
        texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, last_set = None, frozenset()
        for batch in batches:
            keep = []
            for u, text_u, text_v in zip(batch["u"], batch["text_u"], batch["text_v"]):
                if text_u is not last:
                    if text_u != last:
                        last_set = shingle_set(text_u, width)
                    last = text_u
                other = shingle_set(text_v, width)
                common = len(last_set & other)
                keep.append(100 * common >= percent * (len(last_set) + len(other) - common) > 0)
            yield batch.loc[np.array(keep, dtype=bool), ["u", "v"]]

    return both.select("u", "v", "text_u", "text_v").mapInPandas(run, "u long, v long")


def _component(df: DataFrame, comps: DataFrame, node: str, name: str) -> DataFrame:
    """``df`` with the component of column ``node``; a node without links is its own."""
    side = comps.select(F.col("node").alias(node), F.col("component").alias(name))
    return df.join(side, node, "left").withColumn(name, F.coalesce(name, node))


def across(met: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (u, v): each class with one leader per foreign component among its buckets."""
    pairs = met.where("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    placed = _component(_component(pairs, comps, "u", "cu"), comps, "v", "cv").where("cu <> cv")
    return placed.groupBy("v", "cu").agg(F.min("u").alias("u")).select("u", "v")


def crossing(met: DataFrame, classes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of one bucket whose classes are still in different components.

    Such pairs meet under a band of the first collection.  Each is taken under the first band
    that it shares, and only if it shares one of the second collection too, so it comes once.
    """
    placed = _component(met.select("key", "node"), comps, "node", "component")
    mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    nodes = placed.join(mixed, "key").select("node", "component").distinct().join(classes, "node")
    rows = nodes.select("*", F.posexplode("a").alias("band", "value"))
    side = lambda n: rows.select(
        "band", "value", *[F.col(c).alias(f"{c}_{n}") for c in ("node", "component", "n_shingles", "parity", "a", "b")])
    shared = lambda c, upto: sum((F.when(F.get(f"{c}_u", F.lit(k)) == F.get(f"{c}_v", F.lit(k)), 1).otherwise(0)
                                  * (1 if upto is None else (F.lit(k) < upto).cast("int")) for k in range(SIDE)), F.lit(0))
    met_once = (shared("a", F.col("band")) == 0) & (shared("b", None) > 0)
    pairs = side("u").join(side("v"), ["band", "value"]).where(
        (F.col("component_u") < F.col("component_v"))
        & _room("n_shingles_u", "n_shingles_v", "parity_u", "parity_v", percent) & met_once)
    return pairs.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))


def _merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: those that a link joins become one."""
    both = _component(_component(links, comps, "u", "cu"), comps, "v", "cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    again = cut(components(both), "merged")
    moved = comps.join(again.select(F.col("node").alias("component"), F.col("component").alias("last")), "component", "left").select(
        "node", F.coalesce("last", "component").alias("component"))
    fresh = again.join(comps, "node", "left_anti")
    return cut(moved.unionByName(fresh), "components")


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    signed = cut(signatures(docs, width), "signatures")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    classes = cut(known.groupBy("set_key").agg(
        F.min("doc_id").alias("node"),
        F.min_by(F.struct("n_shingles", "a", "b", "sketch", "parity"), "doc_id").alias("own"),
    ).select("set_key", "node", "own.*"), "classes")
    met = cut(buckets(classes), "buckets")
    tried = None
    comps = cut(classes.select("node", F.col("node").alias("component")).limit(0), "components")
    # First the smallest leader of each class, then one leader of each foreign component it
    # meets, at last whatever still meets across components.
    for pairs_of in (
        lambda: met.where("node <> leader").groupBy(F.col("node").alias("v")).agg(F.min("leader").alias("u")),
        lambda: across(met, comps),
        lambda: crossing(met, classes, comps, percent),
    ):
        pairs = pairs_of().select("u", "v")
        fresh = pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti")
        fresh = cut(plausible(fresh, classes, percent), "pairs")
        comps = _merge(comps, cut(confirm(fresh, docs, width, percent), "confirmed"))
        tried = fresh if tried is None else tried.unionByName(fresh)
    of_class = _component(classes.select("set_key", "node"), comps, "node", "component_id").select("set_key", "component_id")
    joined = signed.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, columns unchanged; of rows with one id only one stays."""
    from lectern.llm.decontaminate import without_ids

    judged = cut(groups(docs, width, percent).select("doc_id", "kept"), "judged")
    left = without_ids(docs, judged.where("not kept"))
    repeated = cut(judged.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    once = left.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return without_ids(left, repeated).unionByName(once)
