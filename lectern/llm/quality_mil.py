"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` characters.  Every passage is described by
shares of character classes, word shapes and repetition, and encoded by one layer.  Gated
attention gives each passage a weight, the weighted sum represents the document, and a
logistic unit scores it.  All weights are learned together from document labels alone.

Learning takes a bounded sample of labelled documents: the ``SAMPLE`` smallest by a hash of
their id, and of each at most ``SAMPLE_PASSAGES`` passages, evenly spread.  Scoring reads
every passage of every document.

Defined results: a null or empty text is one passage without characters and gets a score
like any other; documents without a label are scored and not learned from; of repeated or
contradicting labels of a document the mean is learned; without labels all scores are 0.5.
Only ``doc_id`` and ``text`` of the documents and ``doc_id`` and ``quality`` of the labels
are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 600
SAMPLE = 4000
SAMPLE_PASSAGES = 48
HIDDEN, GATE = 16, 8
STEPS, RATE, DECAY = 400, 0.02, 1e-4
THRESHOLD = 0.3
CHUNK = 1_000_000  # characters described at once inside a task

# Character classes: one share per class is a feature.
_CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "comma", "pipe", "bang", "sign", "other")
_SIGNS = {".": 5, "?": 5, ",": 6, ";": 6, ":": 6, "|": 7, "!": 8}


def _class_of(code: int) -> int:
    c = chr(code)
    if c in _SIGNS:
        return _SIGNS[c]
    if c == "\n":
        return 4
    if c.isspace():
        return 3
    if c.isdigit():
        return 2
    if c.isalpha():
        return 1 if c.isupper() else 0
    return 9 if code < 128 or unicodedata.category(c)[0] in "PS" else 10


_TABLE = np.array([_class_of(i) for i in range(0x3000)], dtype=np.int64)
N_CLASSES = len(_CLASSES)
#: Class shares, then: doubled characters, words per character, share of distinct words, of
#: words that repeat the one before, of words of one to three letters, mean word length,
#: fullness of the passage, logarithm of the document's length.
FEATURES = N_CLASSES + 8


def passages_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the number of passages of each text."""
    blocks, counts = [], []
    at = 0
    while at < len(texts):
        chunk, size = [], 0
        while at < len(texts) and (not chunk or size + len(texts[at]) <= CHUNK):
            chunk.append(texts[at])
            size += len(texts[at])
            at += 1
        feats, n = _describe(chunk)
        blocks.append(feats)
        counts.append(n)
    if not blocks:
        return np.zeros((0, FEATURES)), np.zeros(0, dtype=np.int64)
    return np.concatenate(blocks), np.concatenate(counts)


def _describe(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begin = np.cumsum(sizes) - sizes
    inside = np.arange(len(codes)) - np.repeat(begin, sizes)
    owner = np.repeat(first, sizes) + inside // PASSAGE
    kinds = np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], N_CLASSES - 1)
    shares = np.bincount(owner * N_CLASSES + kinds, minlength=total * N_CLASSES).reshape(total, N_CLASSES).astype(float)
    n_chars = shares.sum(axis=1)
    doubled = np.zeros(total)
    if len(codes) > 1:
        same = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
        doubled = np.bincount(owner[1:][same], minlength=total).astype(float)
    words = np.zeros((total, 5))
    k = 0
    for text, n in zip(texts, counts):
        for p in range(n):
            own = text[p * PASSAGE : (p + 1) * PASSAGE].split()
            if own:
                words[k] = (len(own), len(set(own)), sum(map(str.__eq__, own, own[1:])),
                            sum(len(w) < 4 for w in own), sum(map(len, own)))
            k += 1
    n_words = np.maximum(words[:, 0], 1.0)
    full = np.maximum(n_chars, 1.0)
    out = np.column_stack([
        shares / full[:, None], doubled / full, words[:, 0] / full, words[:, 1] / n_words, words[:, 2] / n_words,
        words[:, 3] / n_words, words[:, 4] / n_words / 10.0, n_chars / PASSAGE, np.log1p(np.repeat(sizes, counts)) / 10.0,
    ])
    return out, counts


class Model:
    """Weights of the encoder, the gated attention and the output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.w = {
            "encode": small(FEATURES, HIDDEN), "bias": np.zeros(HIDDEN),
            "tanh": small(HIDDEN, GATE), "gate": small(HIDDEN, GATE), "attend": small(GATE),
            "out": small(HIDDEN), "level": np.zeros(1),
        }

    def forward(self, feats: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        starts = np.cumsum(counts) - counts
        x = np.clip((feats - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ w["encode"] + w["bias"])
        t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        a = (t * g) @ w["attend"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), counts))
        a /= np.repeat(np.add.reduceat(a, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        score = 1 / (1 + np.exp(-(z @ w["out"] + w["level"][0])))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": score, "starts": starts}

    def scores(self, feats: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(feats, counts)["score"] if len(counts) else np.zeros(0)

    def fit(self, feats: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
        """Full-batch gradient steps with adaptive rates; both classes weigh the same."""
        self.mean, self.spread = feats.mean(axis=0), feats.std(axis=0) + 1e-6
        positive = max(float(labels.mean()), 1e-6)
        weight = labels / positive + (1 - labels) / max(1 - positive, 1e-6)
        weight /= weight.sum()
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, STEPS + 1):
            for k, grad in self._gradient(feats, counts, labels, weight).items():
                grad = grad + DECAY * self.w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad**2
                self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        # Undo the class weights, so that the score is a probability at the given shares.
        self.w["level"] = self.w["level"] + np.log(positive / max(1 - positive, 1e-6))
        return self

    def _gradient(self, feats, counts, labels, weight) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(feats, counts)
        d_out = weight * (f["score"] - labels)
        d_z = d_out[:, None] * w["out"]
        d_z_each = np.repeat(d_z, counts, axis=0)
        d_h = f["a"][:, None] * d_z_each
        d_a = (d_z_each * f["h"]).sum(axis=1)
        mean_a = np.repeat(np.add.reduceat(f["a"] * d_a, f["starts"]), counts)
        d_e = f["a"] * (d_a - mean_a)
        d_tg = d_e[:, None] * w["attend"]
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h = d_h + d_t @ w["tanh"].T + d_g @ w["gate"].T
        d_x = d_h * (1 - f["h"] ** 2)
        return {
            "encode": f["x"].T @ d_x, "bias": d_x.sum(axis=0), "tanh": f["h"].T @ d_t, "gate": f["h"].T @ d_g,
            "attend": (f["t"] * f["g"]).T @ d_e, "out": f["z"].T @ d_out, "level": np.array([d_out.sum()]),
        }


def sample_of(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """The bounded training sample: doc_id, text, label of documents outside the held-out part.

    The ids are chosen from the labels alone, so only the sample's texts are looked up; the
    list of ids is broadcast, it has at most ``SAMPLE`` rows.
    """
    from lectern.llm.language_id import held_out

    known = labels.where("quality is not null and doc_id is not null").where(~held_out(modulus, remainder))
    means = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("label"))
    chosen = means.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one row per id, also of repeated rows


def learn(sample: DataFrame) -> Model | None:
    """Fit on the sample's passages; None if there are no labels of both kinds."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            feats, counts = passages_of([t or "" for t in batch["text"]])
            ends = np.cumsum(counts)
            rows = []
            for end, n, label, doc_id in zip(ends, counts, batch["label"], batch["doc_id"]):
                at = np.unique(np.linspace(end - n, end - 1, min(n, SAMPLE_PASSAGES)).astype(int))
                rows.append((doc_id, float(label), feats[at].ravel().tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "feats"])

    rows = sample.mapInPandas(describe, "doc_id long, label double, feats array<double>").toPandas()
    rows = rows.sort_values("doc_id")  # a fixed order, so that learning repeats exactly
    labels = rows["label"].to_numpy(dtype=float)
    if not len(labels) or not 0 < labels.mean() < 1:
        return None
    bags = [np.asarray(f, dtype=float).reshape(-1, FEATURES) for f in rows["feats"]]
    return Model().fit(np.concatenate(bags), np.array([len(b) for b in bags]), labels)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out (passed on), score, predicted of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            scores = m.scores(*passages_of(texts)) if m else np.full(len(texts), 0.5)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores,
                                "predicted": (scores >= THRESHOLD).astype("int32")})

    return docs.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Learn outside the held-out part, score every document."""
    from lectern.llm.language_id import held_out

    model = learn(sample_of(docs, labels, modulus, remainder))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus, remainder).alias("held_out"), "text")
    return score(every, model)


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    model = learn(sample_of(docs, labels, modulus, remainder))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = m.scores(*passages_of(texts)) if m else np.full(len(texts), 0.5)
            yield batch.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
