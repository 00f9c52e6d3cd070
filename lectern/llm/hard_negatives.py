"""Hard-negative mining over an inverted multi-index, exact by certified bounds.

Vectors are rounded down to whole numbers.  Their two halves are coded apart, each by its own
codebook learned from a bounded sample; a pair of codes is a cell of the index, and every row is
filed in its cell.  Per cell the index keeps how far its rows lie from the two code words.

An anchor orders the cells without listing them: a heap walks the two sorted lists of half-scores
(anchor half times code word, plus the anchor half's length times the radius), so cells come in
the order of an upper bound on the score of any row in them.  The bound from a cell's own radii
is tighter and leaves more cells out.  A search asks for the best rows inside score windows.  Its
first visit opens the cells in that order until they hold ``FIRST_ROWS`` rows; what is found
there is a lower limit of the result.  The second visit opens every other cell whose bound
reaches the limit of a window, and stops at the first one that cannot: then each window is
certified, so no score is lost, whatever the codebooks are.

Mining asks twice: for an anchor's best rows of its own label, and then, with a window under
the score of each of these positives, for the best rows of other labels.

Spark's part: anchors and rows are packed in blocks (rows by cell, so a hot cell is many
blocks); visits are joins of block numbers, scores are products of two blocks, and only the best
few per anchor, window and batch leave a task.  The driver holds the sample, the codebooks and
one row per cell, of which there are at most ``MOST_CODES`` squared.  The number of codes
follows the number of rows so that cells keep about ``CELL_ROWS`` rows.

Defined results: rows with a null id, label or vector, with a null or non-finite component, or
with one of 2**20 or more (whose scores a long may not hold) take no part; vectors of different
lengths are multiplied as far as both reach, so an empty vector scores 0; repeated ids are rows
of their own, and of rows with equal id and score any may come first, which the result does not
show; anchors without positives or windows without rows give no rows, nor does an empty
table.  Only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.store import cut

SCALE = 256
LARGEST = 1 << 20
#: Rows the codebooks are learned from; every row is filed by them.
SAMPLE = 8192
CELL_ROWS, MOST_CODES, ROUNDS = 256, 256, 8
FIRST_ROWS = 1024
#: Bytes of the vectors of one block, of rows or anchors.
BLOCK_BYTES = 1 << 16
LOWEST, HIGHEST = -(2**62), 2**62
NONE = np.iinfo(np.int64).min
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Index:
    """Codebooks of both halves and, per cell, its number of rows and the radii of its halves."""

    codes: list[np.ndarray]
    size: int
    wide: bool
    count: np.ndarray | None = None
    radius: list[np.ndarray] | None = None

    @property
    def half(self) -> int:
        return self.codes[0].shape[1]

    def halves(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors[..., : self.half], vectors[..., self.half :]]

    def file(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cell of each vector, and the distances of its halves from their code words."""
        nearest, far = [], []
        for part, book in zip(self.halves(vectors), self.codes):
            at = np.argmin((book**2).sum(axis=1) - 2 * part @ book.T, axis=1)
            nearest.append(at)
            far.append(np.sqrt(((part - book[at]) ** 2).sum(axis=1)))
        return nearest[0] * len(self.codes[1]) + nearest[1], far


def codebook(part: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` code words by rounds of nearest means."""
    rng = np.random.default_rng(seed)
    book = part[rng.permutation(len(part))[:n]].copy()
    for _ in range(ROUNDS):
        at = np.argmin((book**2).sum(axis=1) - 2 * part @ book.T, axis=1)
        counts = np.bincount(at, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, at, part)
        book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return book


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v: the rows that take part, rounded down."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("int")).alias("v"))


def _matrix(vectors, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def learn(rows: DataFrame) -> Index | None:
    """Codebooks from the ``SAMPLE`` rows with the smallest hashes of their ids."""
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if not facts["n"]:
        return None
    size = max(facts["size"], 2)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(SAMPLE).select("v").toPandas()["v"]
    vectors = _matrix(sample, size)
    n = min(MOST_CODES, len(vectors), math.ceil(math.sqrt(facts["n"] / CELL_ROWS)))
    half = size // 2
    return Index([codebook(vectors[:, :half], n, 1), codebook(vectors[:, half:], n, 2)], size, size * (facts["most"] or 0) ** 2 >= 1 << 52)


FILED = "uid long, vec_id long, label long, cell int, far_0 double, far_1 double, v binary"


def file_rows(rows: DataFrame, index: Index) -> DataFrame:
    """Every row with its cell, its halves' distances and its vector packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = _matrix(batch["v"], index.size)
            cell, far = index.file(vectors)
            packed = [row.tobytes() for row in vectors.astype(np.int32)]
            yield pd.DataFrame({"uid": batch["uid"], "vec_id": batch["vec_id"], "label": batch["label"], "cell": cell.astype(np.int32),
                                "far_0": far[0], "far_1": far[1], "v": packed})

    return rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "label", "v").mapInPandas(run, FILED)


def with_cells(index: Index, filed: DataFrame) -> Index:
    """The index with its cells: at most ``MOST_CODES`` squared rows come to the driver."""
    cells = filed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far_0").alias("r0"), F.max("far_1").alias("r1")).toPandas()
    shape = tuple(len(book) for book in index.codes)
    tables = [np.zeros(shape) for _ in range(3)]
    for table, name in zip(tables, ("n", "r0", "r1")):
        table.reshape(-1)[cells["cell"]] = cells[name]
    return Index(index.codes, index.size, index.wide, tables[0], tables[1:])


BLOCKS = "block long, cell int, uids array<long>, ids array<long>, labels array<long>, m binary"


def packed(filed: DataFrame, size: int, by_cell: bool) -> DataFrame:
    """Rows in blocks of at most ``size``, in the order of cell and id; of one cell each if ``by_cell``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held["cell"].to_numpy()
            cuts = (np.flatnonzero(np.diff(last)) + 1).tolist() if by_cell else []
            done, rows = 0, []
            for end in [*cuts, len(held)]:
                # The last stretch may go on in the next batch.
                while end - done >= size or (done < end < len(held)):
                    upto = min(done + size, end)
                    rows.append(block(number, held.iloc[done:upto]))
                    number, done = number + 1, upto
            held = held.iloc[done:].reset_index(drop=True)
            if rows:
                yield pd.DataFrame(rows)
        if held is not None and len(held):
            yield pd.DataFrame([block(number, held)])

    def block(number: int, rows: pd.DataFrame) -> dict:
        return {"block": number, "cell": rows["cell"].iloc[0], "uids": rows["uid"].tolist(), "ids": rows["vec_id"].tolist(),
                "labels": rows["label"].tolist(), "m": b"".join(rows["v"])}

    ordered = filed.repartitionByRange("cell", "vec_id", "uid").sortWithinPartitions("cell", "vec_id", "uid")
    return ordered.select("uid", "vec_id", "label", "cell", "v").mapInPandas(run, BLOCKS)


def by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """sum, i, j of all pairs in falling order of ``first[i] + second[j]``: the multi-sequence heap."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    first, second = first.tolist(), second.tolist()
    heap, pushed = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        less, i, j = heapq.heappop(heap)
        yield -less, a[i], b[j]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (-(first[a[x]] + second[b[y]]), x, y))


def cells_of(index: Index, anchor: np.ndarray, limit: float, most: float, rows: float) -> list[int]:
    """Cells that may hold a score from ``limit`` to ``most``, best bound first, until they hold ``rows`` rows."""
    parts = index.halves(anchor)
    length = [float(np.sqrt((p**2).sum())) for p in parts]
    middle = [book @ p for p, book in zip(parts, index.codes)]
    # Room for the rounding of the sums.
    room = [1 + 1e-9 * n * np.sqrt((book**2).sum(axis=1)) for n, book in zip(length, index.codes)]
    reach = [(1 + 1e-9) * n * r for n, r in zip(length, index.radius)]
    upper = [middle[0] + room[0] + reach[0].max(axis=1), middle[1] + room[1] + reach[1].max(axis=0)]
    out, held = [], 0.0
    for bound, i, j in by_bound(*upper):
        if bound < limit or held >= rows:
            break
        around = reach[0][i, j] + reach[1][i, j] + room[0][i] + room[1][j]
        score = middle[0][i] + middle[1][j]
        if index.count[i, j] and score + around >= limit and score - around <= most:
            out.append(i * len(index.codes[1]) + j)
            held += index.count[i, j]
    return out


def opened(asked: DataFrame, index: Index, rows: float) -> DataFrame:
    """block, cell: the cells that a block of anchors opens, without those in ``before``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for number, m, slots, low, high, before in zip(*(batch[c] for c in ("block", "m", "slots", "low", "high", "before"))):
                vectors = np.frombuffer(m, dtype=np.int32).reshape(-1, index.size).astype(float)
                cells: set[int] = set()
                slots, low, high = np.asarray(slots), np.asarray(low, dtype=float), np.asarray(high, dtype=float)
                for slot in np.unique(slots):
                    own = slots == slot
                    cells.update(cells_of(index, vectors[slot], low[own].min(), high[own].max(), rows))
                out += [(number, cell) for cell in sorted(cells.difference(() if before is None else before.tolist()))]
            yield pd.DataFrame(out, columns=["anchors", "cell"])

    return asked.select("block", "m", "slots", "low", "high", "before").mapInPandas(run, "anchors long, cell int")


def best_of(scores: np.ndarray, fits: np.ndarray, n: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``n`` best fitting scores of every row; equal scores by column."""
    columns = scores.shape[1]
    if wide:
        order = np.argsort(np.where(fits, scores, NONE)[:, ::-1], axis=1, kind="stable")[:, ::-1]
        at = columns - 1 - order[:, :n]
    else:
        key = np.where(fits, scores * columns + np.arange(columns - 1, -1, -1), NONE)
        at = np.argpartition(key, columns - n, axis=1)[:, columns - n :] if columns > n else np.broadcast_to(np.arange(columns), key.shape)
    row = np.repeat(np.arange(len(scores)), at.shape[1])
    column = at.reshape(-1)
    held = fits[row, column]
    return row[held], column[held]


def scored(visits: DataFrame, asked: DataFrame, rows: DataFrame, index: Index, n: int, same: bool) -> DataFrame:
    """uid, k, score, vec_id: the best ``n`` rows per window of the blocks opened, at least."""
    directory = rows.select("block", "cell")
    pairs = visits.join(directory, "cell").select("anchors", "block")
    left = asked.select(F.col("block").alias("anchors"), *[F.col(c).alias(f"a_{c}") for c in ("uids", "labels", "m", "slots", "ks", "low", "high")])
    both = pairs.join(left, "anchors").join(rows.drop("cell"), "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = np.int64 if index.wide else float
        matrix = lambda m: np.frombuffer(m, dtype=np.int32).reshape(-1, index.size).astype(number)
        for batch in batches:
            out = []
            for r in batch.itertuples():
                slots, low, high = r.a_slots, np.asarray(r.a_low)[:, None], np.asarray(r.a_high)[:, None]
                scores = (matrix(r.a_m) @ matrix(r.m).T).astype(np.int64)
                alike = r.a_labels[:, None] == r.labels[None, :]
                fits = alike & (r.a_uids[:, None] != r.uids[None, :]) if same else ~alike
                own = scores[slots]
                at, column = best_of(own, fits[slots] & (own >= low) & (own <= high), n, index.wide)
                out.append(pd.DataFrame({"uid": r.a_uids[slots[at]], "k": r.a_ks[at], "score": own[at, column], "vec_id": r.ids[column]}))
            if out:
                # Of all pairs of blocks in the batch, too, only the best few per window go on.
                met = pd.concat(out).sort_values(["score", "vec_id"], ascending=[False, True])
                yield met.groupby(["uid", "k"], sort=False).head(n)

    columns = [c for c in both.columns if c not in ("anchors", "block")]
    return both.select(*columns).mapInPandas(run, "uid long, k int, score long, vec_id long")


def _top(found: DataFrame, n: int) -> DataFrame:
    """The best ``n`` per anchor and window; each task sorts out its own before the shuffle."""
    order = W.partitionBy("uid", "k").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _asked(anchors: DataFrame, windows: DataFrame, opened_before: DataFrame | None) -> DataFrame:
    """Blocks of anchors with their windows (at most a few per anchor) and the cells already opened."""
    flat = anchors.select("block", F.posexplode("uids").alias("slot", "uid"))
    own = flat.join(windows, "uid").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "k", "low", "high"))).alias("w"))
    field = lambda c: F.transform("w", lambda x: x[c])
    asked = anchors.join(own, "block").select(
        "*", field("slot").alias("slots"), field("k").alias("ks"), field("low").alias("low"), field("high").alias("high")).drop("w")
    if opened_before is None:
        return asked.withColumn("before", F.array().cast("array<int>"))
    seen = opened_before.groupBy(F.col("anchors").alias("block")).agg(F.collect_list("cell").alias("before"))
    return asked.join(seen, "block", "left")


def search(anchors: DataFrame, rows: DataFrame, index: Index, windows: DataFrame, n: int, same: bool) -> DataFrame:
    """uid, k, score, vec_id, rank: the best ``n`` rows of every window (uid, k, low, high), of the anchor's label or of others."""
    windows = cut(windows.where("low <= high"), "windows")
    first = cut(_asked(anchors, windows, None), "asked")
    visits = cut(opened(first, index, FIRST_ROWS), "visits")
    found = cut(_top(scored(visits, first, rows, index, n, same), n).drop("rank"), "found")
    # What n rows reach already is the limit; a window with fewer keeps its own.
    known = found.groupBy("uid", "k").agg(F.count("*").alias("held"), F.min("score").alias("least"))
    limits = windows.join(known, ["uid", "k"], "left").select(
        "uid", "k", F.when(F.col("held") >= n, F.col("least")).otherwise(F.col("low")).alias("low"), "high")
    second = cut(_asked(anchors, limits, visits), "asked")
    more = scored(cut(opened(second, index, math.inf), "visits"), second, rows, index, n, same)
    return _top(found.unionByName(more), n)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """``RESULT`` rows: hard negatives of every anchor and positive, scored ``least`` to ``most`` per cent of the positive."""
    rows = usable(vectors)
    index = learn(rows)
    if index is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    filed = cut(file_rows(rows, index), "filed")
    index = with_cells(index, filed)
    size = max(16, BLOCK_BYTES // (4 * index.size))
    blocks = cut(packed(filed, size, True), "blocks")
    own = cut(filed.where(is_anchor), "own")
    anchors = cut(packed(own, size, False), "anchors")
    everything = own.select("uid", F.lit(0).alias("k"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
    near = cut(search(anchors, blocks, index, everything, positives, True), "positives")
    # Whole scores: rounded up for the lower end and down for the upper end of a window.
    share = lambda c, percent: F.expr(f"({percent} * cast({c} as decimal(22,0)))")
    windows = near.select("uid", F.col("rank").alias("k"), F.ceil(share("score", least) / 100).cast("long").alias("low"),
                          F.floor(share("score", most) / 100).cast("long").alias("high"))
    far = search(anchors, blocks, index, windows, negatives, False)
    of_anchor = own.select("uid", F.col("vec_id").alias("anchor_id"))
    pairs = near.select("uid", F.col("rank").alias("k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = far.select("uid", "k", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        pairs, ["uid", "k"]).join(of_anchor, "uid")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
