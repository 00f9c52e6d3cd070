"""Exact removal of repeated byte strings, by suffix arrays over shards.

Every string of ``size`` bytes that occurs twice anywhere is removed, byte by byte.

1. A string's *anchor* is the smallest hash among its substrings of ``size // 2`` bytes.
   Equal strings have equal anchors, so a shard of anchors holds every string it needs.
   Neighbouring strings with one anchor form a *run*, a piece of text of about
   ``1.25 * size`` bytes.  One pass over the texts gives all runs; equal runs of a batch are
   one row that lists where they occur.
2. Runs whose anchor occurs once drop out, unless the anchor occurs again inside the run.
   Equal runs repeat as a whole.
3. The rest, runs that share an anchor but not all bytes, are cut from the texts and sorted
   in shards: induced sorting gives the suffix array, and a string is repeated if its
   permuted common prefix, or that of the next suffix, has ``size`` bytes.
   An anchor with more than ``WIDE`` such runs does not fit a shard; its strings are counted
   by 128-bit hashes instead, which gives the same strings and splits over the cluster.
4. The repeated starts of a text, as ranges, meet the text again and are cut out.

A text is known by its 64-bit hash and its number of bytes, as equal texts lose the same.

Defined results: null and empty texts have no bytes; texts shorter than ``size`` stay whole;
repeated rows are copies of each other and lose all strings; an empty table gives no rows.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.llm.store import cut
from lectern.llm.suffix_sort import permuted_prefixes, suffix_array
from lectern.llm.words import mix

SIZE = 200
#: Runs of one anchor that a shard takes; about 250 bytes each.
WIDE = 2000
#: Bytes sorted at once inside a task.
SHARD = 1_000_000
#: Text keys up to this many rows (12 bytes each) are broadcast.
BROADCAST_ROWS = 1_000_000

_PLACE = np.dtype([("key", "<i8"), ("n_bytes", "<u4"), ("start", "<u4")])
_BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}
_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) <= n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                _POWERS[name] = np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * n, base, dtype=np.uint64)))
    return _POWERS["up"], _POWERS["down"]


def key_of(data: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(data)).view(np.int64))


class Rolling:
    """Hashes of all substrings of one text."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, dtype=np.uint8)
        self.up, self.down = _powers(len(raw))
        self.total = np.append(np.uint64(0), np.add.accumulate(_SPREAD[raw] * self.up[: len(raw)]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]

    def grams(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return mix((self.total[size:] - self.total[:n]) * self.down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, from minima to both sides of block borders."""
    n = len(values)
    padded = np.append(values, np.full(-n % width, np.iinfo(np.uint64).max, dtype=np.uint64)).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs_of(data: bytes, size: int) -> tuple[np.ndarray, ...] | None:
    """anchor, hash, start, count, twin of the runs of one text; None if it is too short.

    ``twin`` marks runs in which the anchor's bytes occur twice: only they can hold a string
    twice themselves.
    """
    if len(data) < size:
        return None
    half = size // 2
    rolling = Rolling(data)
    grams = rolling.grams(half)
    anchors = sliding_min(grams, size - half + 1)
    start = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    count = np.diff(np.append(start, len(anchors)))
    anchor = anchors[start]
    spans = count + size - half
    offset = np.cumsum(spans) - spans
    inside = np.arange(int(spans.sum())) - np.repeat(offset, spans) + np.repeat(start, spans)
    seen = np.add.reduceat((grams[inside] == np.repeat(anchor, spans)).astype(np.int64), offset)
    whole = mix(rolling.of(start, start + count + size - 1) ^ count.astype(np.uint64))
    return anchor.view(np.int64), whole.view(np.int64), start, count, seen > 1


RUN = "anchor long, hash long, n int, count int, twin boolean, places binary"


def _runs(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts: dict[str, int] = {}
            for text in batch["text"]:
                if text and len(text) * 4 >= size:
                    texts[text] = texts.get(text, 0) + 1
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            place = []
            for text, n in texts.items():
                data = text.encode("utf-8", "surrogatepass")
                found = runs_of(data, size)
                if found is None:
                    continue
                for col, values in zip(cols, (*found, np.full(len(found[0]), n))):
                    col.append(values)
                own = np.empty(len(found[0]), dtype=_PLACE)
                own["key"], own["n_bytes"], own["start"] = key_of(data), len(data), found[2]
                place.append(own)
            if not place:
                continue
            anchor, whole, _, count, twin, n = (np.concatenate(c) for c in cols)
            places = np.concatenate(place)
            by = np.lexsort((whole, anchor))
            anchor, whole = anchor[by], whole[by]
            first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])))
            packed, ends = places[by].tobytes(), np.append(first[1:], len(by)) * _PLACE.itemsize
            yield pd.DataFrame({
                "anchor": anchor[first], "hash": whole[first], "n": np.add.reduceat(n[by], first).astype(np.int32),
                "count": count[by][first].astype(np.int32), "twin": twin[by][first],
                "places": [packed[a:b] for a, b in zip((first * _PLACE.itemsize).tolist(), ends.tolist())]})

    return run


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per place of a run."""
    for batch in batches:
        sizes = batch["places"].map(len).to_numpy() // _PLACE.itemsize
        places = np.frombuffer(b"".join(batch["places"]), dtype=_PLACE)
        out = {c: np.repeat(batch[c].to_numpy(), sizes) for c in batch.columns if c != "places"}
        yield pd.DataFrame(out | {"key": places["key"], "n_bytes": places["n_bytes"].astype(np.int64), "start": places["start"].astype(np.int32)})


def _sort_shard(strings: list[bytes], size: int) -> list[np.ndarray]:
    """For each string, the starts whose ``size`` bytes occur elsewhere among the strings."""
    joined = np.frombuffer(b"\x00".join(strings), dtype=np.uint8)
    lengths = np.array([len(s) for s in strings])
    begin = np.cumsum(lengths + 1) - lengths - 1
    # Symbol 0 parts the strings; bytes follow it, so that no prefix reaches into the next string.
    text = joined.astype(np.int64) + 1
    text[begin[1:] - 1] = 0
    order = suffix_array(text)
    prefix = permuted_prefixes(text, order, size)
    # A part may hold the separator only beyond the end of a string, never within a valid start.
    follows = np.zeros(len(text), dtype=np.int64)
    follows[order[:-1]] = prefix[order[1:]]
    repeated = np.maximum(prefix, follows) >= size
    return [np.flatnonzero(repeated[b : b + max(0, n - size + 1)]) for b, n in zip(begin, lengths)]


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, np.diff(starts) != 1))
    return starts[first], np.diff(np.append(first, len(starts)))


MARK = "key long, n_bytes long, start int, count int"


def _shards(size: int):
    """Strings, sorted by anchor, in groups of whole anchors up to ``SHARD`` bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        total = 0

        def flush() -> pd.DataFrame:
            rows = []
            for (key, n_bytes, start, _, own, _), starts in zip(held, _sort_shard([h[5] for h in held], size)):
                if own and len(starts):
                    rows.extend((key, n_bytes, start + int(s), int(c)) for s, c in zip(*_ranges(starts)))
            return pd.DataFrame(rows, columns=["key", "n_bytes", "start", "count"])

        for batch in batches:
            for row in zip(batch["key"], batch["n_bytes"], batch["start"], batch["anchor"], batch["own"], batch["bytes"]):
                if held and row[3] != held[-1][3] and total > SHARD:
                    yield flush()
                    held, total = [], 0
                held.append(row)
                total += len(row[5])
        if held:
            yield flush()

    return run


def repeated_starts(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """key, n_bytes, start, count: ranges of starts of repeated strings, by text."""
    narrow = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    runs = narrow.mapInPandas(_runs(size), RUN)
    one, same = W.partitionBy("anchor"), W.partitionBy("anchor", "hash")
    met = runs.select(
        "*", F.sum("n").over(one).alias("of_anchor"), (F.min("hash").over(one) < F.max("hash").over(one)).alias("mixed"),
        F.sum("n").over(same).alias("equal"), F.row_number().over(same.orderBy("places")).alias("rank"),
    ).where("of_anchor > 1 or twin")
    met = cut(met, "runs")
    whole = met.where("equal > 1").select("count", "places").mapInPandas(_unpack, "count int, key long, n_bytes long, start int").select(
        "key", "n_bytes", "start", "count")
    # One occurrence of every run that may share part of its strings; whole ones only as partners.
    parts = met.where("rank = 1 and (mixed or twin)").select(
        "anchor", "count", (F.col("equal") == 1).alias("own"), F.substring("places", 1, _PLACE.itemsize).alias("places"))
    parts = parts.mapInPandas(_unpack, "anchor long, count int, own boolean, key long, n_bytes long, start int")
    wide = parts.groupBy("anchor").agg(F.count("*").alias("runs"), F.max("own").alias("open")).where("open")
    parts = cut(parts.join(wide.drop("open"), "anchor"), "parts")
    strings = cut(_strings(parts, docs, size), "strings")
    narrow_ones = strings.where(F.col("runs") <= WIDE).repartition("anchor").sortWithinPartitions("anchor")
    sorted_marks = narrow_ones.mapInPandas(_shards(size), MARK)
    return whole.unionByName(sorted_marks).unionByName(_counted(strings.where(F.col("runs") > WIDE), size))


def _strings(parts: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The bytes of the runs.  Only texts that hold one are moved."""
    keyed = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInPandas(_keyed, "key long, n_bytes long, bytes binary")
    ids = cut(parts.select("key", "n_bytes").distinct(), "keys")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = keyed.join(wanted, ["key", "n_bytes"], "left_semi").dropDuplicates(["key", "n_bytes"])
    return parts.join(texts, ["key", "n_bytes"]).select(
        "key", "n_bytes", "start", "anchor", "own", "runs",
        F.substring("bytes", F.col("start") + 1, F.col("count") + size - 1).alias("bytes"))


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        data = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
        yield pd.DataFrame({"key": [key_of(d) for d in data], "n_bytes": [len(d) for d in data], "bytes": data})


def _counted(strings: DataFrame, size: int) -> DataFrame:
    """Repeated starts of anchors with many runs, by counting the strings' hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, n_bytes, start, own, data in zip(batch["key"], batch["n_bytes"], batch["start"], batch["own"], batch["bytes"]):
                n = len(data) - size + 1
                yield pd.DataFrame({
                    "key": key, "n_bytes": n_bytes, "start": np.arange(start, start + n, dtype=np.int32), "own": own,
                    "string": [xxhash.xxh3_128_hexdigest(data[i : i + size]) for i in range(n)]})

    each = strings.select("key", "n_bytes", "start", "own", "bytes").mapInPandas(run, "key long, n_bytes long, start int, own boolean, string string")
    often = each.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    return each.where("own").join(often, "string").select("key", "n_bytes", "start", F.lit(1).alias("count"))


def covered(starts: np.ndarray, counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the bytes that the strings at these ranges of starts cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + counts + size - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove(docs: DataFrame, size: int = SIZE, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every document."""
    marks = repeated_starts(docs, size).groupBy("key", "n_bytes").agg(
        F.collect_list(F.struct("start", "count")).alias("ranges"))  # of one text
    marks = cut(marks.select("key", "n_bytes", F.transform("ranges", lambda r: r["start"]).alias("starts"),
                             F.transform("ranges", lambda r: r["count"]).alias("counts")), "marks")

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "bytes": data, "key": [key_of(d) for d in data], "n_bytes": [len(d) for d in data]})

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, data, n, starts, counts in zip(batch["doc_id"], batch["bytes"], batch["n_bytes"], batch["starts"], batch["counts"]):
                gone = np.zeros(n, dtype=bool)
                if starts is not None:
                    gone = covered(np.asarray(starts, dtype=np.int64), np.asarray(counts, dtype=np.int64), n, size)
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                row = (doc_id, n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept) if with_bytes else row)
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes])
            yield out.astype({"doc_id": "Int64"})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = narrow.mapInPandas(key, "doc_id long, bytes binary, key long, n_bytes long")
    return keyed.join(marks, ["key", "n_bytes"], "left").select("doc_id", "bytes", "n_bytes", "starts", "counts").mapInPandas(
        apply, RESULT + ", kept binary" * with_bytes)
