"""Document fingerprints: SimHash, and search within a Hamming radius by permuted tables.

Every pair of neighbouring words is a term, weighted by the square root of its count.  A
term's hash votes with its weight for or against each of ``BITS`` bits; the signs are the
fingerprint, written in hexadecimal digits.  Texts of one word have that word as their term;
texts without a word have the fingerprint of zeros.  Likeness is the share of equal bits.

Search: the digits are cut into ``radius + 2`` blocks.  Two fingerprints that differ in at
most ``radius`` bits agree in two blocks or more, so a table for every pair of blocks, keyed
by those two, holds all of them; what meets in a table is compared in full.  The tables hold
each distinct fingerprint once, so a group of copies of any size is one entry.

``edited`` compares every document with an edited version and with the next document in
descending order of ids.  Documents are sorted across the cluster once; each task walks its
run and only the first and last document of a run are matched afterwards.

Defined results: a null text is an empty one; null ids come last; documents of one id follow
each other in the order of a hash of their text, then of the text; a single document is its
own next; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.llm import words
from lectern.llm.store import cut

BITS = 128
DIGITS = BITS // 4
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], dtype=np.uint64)


def fingerprint(text: str | None, known: words.WordHash) -> np.ndarray:
    """``BITS`` bits as bytes."""
    h = words.hashes(words.words_of(text), known)
    if not len(h):
        return np.zeros(BITS // 8, dtype=np.uint8)
    terms, counts = np.unique(words.shingles(h, 2), return_counts=True)
    lanes = words.mix(terms[:, None] ^ _SEEDS)
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1)
    weights = np.sqrt(counts)
    return np.packbits(2 * (weights @ bits) > weights.sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - int(np.bitwise_count(a ^ b).sum()) / BITS


def edit(text: str, following: str) -> str:
    """The last third replaced by as many characters from the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(doc_id, text: str, own: np.ndarray, following: str, theirs: np.ndarray, known: words.WordHash) -> tuple:
    other = edit(text, following)
    changed = fingerprint(other, known)
    digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), digest, own.tobytes().hex(), changed.tobytes().hex(),
            likeness(own, changed), likeness(own, theirs))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted run: results of all but the last document; the texts at both ends."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    known = words.WordHash()
    columns = ["part", "kind", *FIELDS, "text"]
    last = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            doc_id, text = (None if pd.isna(doc_id) else int(doc_id)), text or ""
            own = fingerprint(text, known)
            if last is None:
                rows.append((part, "first", doc_id, *[None] * 6, text))
            else:
                rows.append((part, "done", *_compare(*last, text, own, known), None))
            last = (doc_id, text, own)
        yield _frame(rows, columns)
    if last is not None:
        yield _frame([(part, "last", last[0], *[None] * 6, last[1])], columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({c: "Int64" for c in ("doc_id", "n_chars")})


def _close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = words.WordHash()
    for batch in batches:
        rows = [
            _compare(None if pd.isna(i) else int(i), a, fingerprint(a, known), b, fingerprint(b, known), known)
            for i, a, b in zip(batch["doc_id"], batch["text"], batch["following"])
        ]
        yield _frame(rows, list(FIELDS))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited version, and their likeness."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    keys = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    runs = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("text")).select("doc_id", "text")
    walked = cut(runs.mapInPandas(_walk, f"part int, kind string, {RESULT}, text string"), "runs")
    firsts = walked.where("kind = 'first'").select("part", F.col("text").alias("following"))
    # One row per task: which run follows which, the first one after the last.
    order = W.orderBy("part")
    links = firsts.select("part").select(
        F.coalesce(F.lag("part").over(order), F.max("part").over(W.partitionBy())).alias("before"), "part")
    opened = walked.where("kind = 'last'").select(F.col("part").alias("before"), "doc_id", "text")
    ends = opened.join(links, "before").join(firsts, "part").select("doc_id", "text", "following")
    return walked.where("kind = 'done'").select(*FIELDS).unionByName(ends.mapInPandas(_close, RESULT))


def tables(fingerprints: DataFrame, radius: int) -> DataFrame:
    """All columns and ``key``: one row per table, keyed by the two blocks it puts in front."""
    edges = [round(DIGITS * k / (radius + 2)) for k in range(radius + 3)]
    block = [F.substring("fingerprint", a + 1, b - a) for a, b in zip(edges, edges[1:])]
    # A key is a hash: what meets by accident is sorted out by the distance.
    keys = [F.xxhash64(F.lit(i * DIGITS + j), block[i], block[j]) for i, j in combinations(range(radius + 2), 2)]
    return fingerprints.withColumn("key", F.explode(F.array(*keys)))


def packed(fingerprint: Column) -> Column:
    """The fingerprint as two whole numbers, as it travels in the tables."""
    return F.struct(*[F.conv(F.substring(fingerprint, k * 16 + 1, 16), 16, -10).cast("long").alias(f"p{k}") for k in range(DIGITS // 16)])


def distance(a: Column, b: Column) -> Column:
    """Number of differing bits of two packed fingerprints."""
    return sum((F.bit_count(a[f"p{k}"].bitwiseXOR(b[f"p{k}"])) for k in range(DIGITS // 16)), F.lit(0))


def near_classes(asked: DataFrame, classes: DataFrame, radius: int) -> DataFrame:
    """asked, found, distance: pairs of distinct fingerprints (column ``fingerprint``) within ``radius`` bits.

    Only hashes of two blocks and the packed fingerprints are shuffled, never ids.
    """
    left = tables(asked.select("fingerprint").distinct(), radius).select("key", packed(F.col("fingerprint")).alias("asked"))
    right = tables(classes.select("fingerprint").distinct(), radius).select("key", packed(F.col("fingerprint")).alias("found"))
    near = left.join(right, "key").withColumn("distance", distance(F.col("asked"), F.col("found")))
    text = lambda c: F.lower(F.concat(*[F.lpad(F.hex(F.col(f"{c}.p{k}")), 16, "0") for k in range(DIGITS // 16)]))
    # Two fingerprints may meet in several tables.
    pairs = near.where(F.col("distance") <= radius).select("asked", "found", "distance").distinct()
    return pairs.select(text("asked").alias("asked"), text("found").alias("found"), "distance")


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """query_id, doc_id, distance: every document within ``radius`` bits of each query.

    Both sides have doc_id and fingerprint.  Equal fingerprints are one class in the tables,
    so a group of copies meets a query once; the answer lists all its members.
    """
    pairs = near_classes(queries, fingerprints, radius).withColumnRenamed("found", "fingerprint")
    return (
        queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("asked"))
        .join(pairs, "asked").join(fingerprints.select("doc_id", "fingerprint"), "fingerprint")
        .select("query_id", "doc_id", "distance")
    )


def with_counts(fingerprints: DataFrame, is_query: Column, radius: int = 3) -> DataFrame:
    """All columns and ``n_within``: how many documents, itself included, lie within ``radius`` bits of a query's fingerprint.

    Null for rows that are no query.  Members of a class are counted, not listed.
    """
    sizes = fingerprints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    pairs = near_classes(fingerprints.where(is_query), sizes, radius)
    counted = pairs.join(sizes, pairs["found"] == sizes["fingerprint"]).groupBy(F.col("asked").alias("_asked")).agg(
        F.sum("n").alias("n_within"))
    asked = fingerprints.where(is_query).join(counted, F.col("fingerprint") == F.col("_asked"), "left").drop("_asked")
    # Other rows have nothing to join: they do not meet under a null key.
    return asked.unionByName(fingerprints.where(~is_query).withColumn("n_within", F.lit(None).cast("long")))
