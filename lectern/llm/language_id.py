"""Language identification by unigrams of pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  The
likelihood of a word is the sum, over all its segmentations into pieces, of the products of
their probabilities; the forward algorithm computes it, vectorised over distinct words.  A
text's likelihood is the product over its words; the prediction is the language with the
largest posterior, which is the score.

Learning is one step of expectation maximisation from equal probabilities: every training
document adds the expected use of each piece in its words (forward and backward sums).  The
tasks add up what they have read; what reaches the driver is one number per language and
piece, whatever the size of the corpus.

Words are runs of letters in lower case, with an end mark; runs of more than ``LONGEST``
letters are scored in consecutive parts.  A character outside the vocabulary is a piece of
its own that all characters share.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without a
single labelled document every text is ``und``; ties go to the first language by name;
repeated rows count as often as they occur in learning, and are predicted alike.  Only
``doc_id``, ``text`` and, in learning, ``lang`` are read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDEST = 6  # letters of the longest piece used, end mark included
LONGEST = 64  # letters scored as one word
REMEMBERED = 300_000  # distinct words kept per task before they are flushed
SMOOTHING = 0.5  # added to every expected count
START = 1 / 64  # every piece's weight before learning; only the ratio between segmentations counts
END = "\n"
UNKNOWN = 0

_RUNS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = np.uint64(44)  # tables of 2^20 cells


def pieces_of(path: str, widest: int = WIDEST) -> list[str]:
    """The vocabulary's pieces that are letters only, with or without the end mark."""
    from lectern.llm.bpe import BYTE_CHARS

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix = model["end_of_word_suffix"] or ""
    back = {c: b for b, c in BYTE_CHARS.items()}
    out = set()
    for token in model["vocab"]:
        ends = bool(suffix) and token.endswith(suffix)
        try:
            text = bytes(back[c] for c in (token[: -len(suffix)] if ends else token)).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and text.isalpha() and len(text) + ends <= widest:
            out.add(text + END * ends)
    return sorted(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


class Pieces:
    """Vocabulary as a hash table; piece numbers start at 1, 0 is the shared unknown."""

    def __init__(self, pieces: list[str], widest: int = WIDEST):
        self.size, self.widest = len(pieces) + 1, widest
        self.keys = np.zeros((2, 1 << 20), dtype=np.uint64)
        self.values = np.zeros((2, 1 << 20), dtype=np.int32)
        for i, piece in enumerate(pieces, 1):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in _codes(piece):
                    h = (h + c + np.uint64(1)) * _BASE
                at = (int(h >> _BITS), int((h * _TURN) >> _BITS))
            for table in (0, 1):
                if self.values[table, at[table]] == 0:
                    self.keys[table, at[table]], self.values[table, at[table]] = h, i
                    break
            else:
                raise ValueError(f"no cell for piece {piece!r}")

    def find(self, h: np.ndarray) -> np.ndarray:
        one, two = (h >> _BITS).astype(np.int64), ((h * _TURN) >> _BITS).astype(np.int64)
        found = np.where(self.keys[0, one] == h, self.values[0, one], 0)
        return np.where(found == 0, np.where(self.keys[1, two] == h, self.values[1, two], 0), found)

    def lattice(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length: at k-1, the numbers of the pieces of k characters by start."""
        n = len(words[0])
        codes = _codes("".join(words)).reshape(len(words), n)
        out, h = [], np.zeros((len(words), n), dtype=np.uint64)
        for k in range(1, min(self.widest, n) + 1):
            h = (h[:, : n - k + 1] + codes[:, k - 1 :] + np.uint64(1)) * _BASE
            out.append(self.find(h))
        return out


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, members in groups.items():
        step = max(1, 200_000 // n)
        for at in range(0, len(members), step):
            yield n, members[at : at + step]


def _weights(ids: np.ndarray, probs: np.ndarray, k: int) -> np.ndarray:
    """Probability per piece; only single characters may be unknown."""
    w = probs[ids]
    if k > 1:
        w[ids == UNKNOWN] = 0.0
    return w


def log_likelihoods(vocab: Pieces, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Forward sums: words x languages, as logarithms.  ``probs`` is pieces x languages."""
    out = np.zeros((len(words), probs.shape[1]))
    for n, members in _by_length(words):
        lattice = vocab.lattice([words[i] for i in members])
        forward = [np.ones((len(members), probs.shape[1]))]
        scale = np.zeros((len(members), 1))
        for j in range(1, n + 1):
            total = np.zeros_like(forward[0])
            for k in range(1, min(len(lattice), j) + 1):
                total += forward[-k] * _weights(lattice[k - 1][:, j - k], probs, k)
            forward = [*forward[-(vocab.widest - 1) :], total]
            if j % 8 == 0:  # keep the sums away from zero
                top = np.maximum(total.max(axis=1, keepdims=True), 1e-300)
                forward = [f / top for f in forward]
                scale += np.log(top)
        out[members] = np.log(np.maximum(forward[-1], 1e-300)) + scale
    return out


def expected_counts(vocab: Pieces, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (pieces x languages) under equal probabilities.

    ``counts`` is words x languages.  With equal probabilities the share of a piece in a word
    is the same for all languages.
    """
    out = np.zeros((vocab.size, counts.shape[1]))
    equal = np.full(vocab.size, START)
    for n, members in _by_length(words):
        lattice = vocab.lattice([words[i] for i in members])
        weights = [_weights(ids, equal, k + 1) for k, ids in enumerate(lattice)]
        ahead = np.zeros((len(members), n + 1))
        back = np.zeros((len(members), n + 1))
        ahead[:, 0] = back[:, n] = 1.0
        for j in range(1, n + 1):
            for k in range(1, min(len(lattice), j) + 1):
                ahead[:, j] += ahead[:, j - k] * weights[k - 1][:, j - k]
        for i in range(n - 1, -1, -1):
            for k in range(1, min(len(lattice), n - i) + 1):
                back[:, i] += weights[k - 1][:, i] * back[:, i + k]
        whole = np.maximum(ahead[:, n], 1e-300)
        for k, ids in enumerate(lattice, 1):
            share = ahead[:, : n - k + 1] * weights[k - 1] * back[:, k:] / whole[:, None]
            for lang in range(counts.shape[1]):
                use = share * counts[members, lang][:, None]
                out[:, lang] += np.bincount(ids.ravel(), use.ravel(), vocab.size)
    return out


def words_of(text: str) -> list[str]:
    """Runs of letters; a run may hold numeral signs that are no letters, kept out later."""
    return _RUNS.findall(text.lower())


def marked(run: str) -> list[str]:
    """A run as the words that are scored: letters only, cut to length, end mark on the last."""
    run = run if run.isalpha() else "".join(c for c in run if c.isalpha())
    if not run:
        return []
    parts = [run[i : i + LONGEST] for i in range(0, len(run), LONGEST)]
    return [*parts[:-1], parts[-1] + END]


def held_out(modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


class Model:
    """Languages, log priors and piece probabilities; a few MB."""

    def __init__(self, langs: list[str], prior: np.ndarray, probs: np.ndarray, pieces: list[str]):
        self.langs, self.prior, self.probs, self.pieces = langs, prior, probs, pieces


def learn(docs: DataFrame, path: str) -> Model:
    """Fit on all rows of ``docs`` (text, lang) with both set."""
    spark = docs.sparkSession
    pieces = pieces_of(path)
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    shipped = spark.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = Pieces(shipped.value)
        seen: dict[str, Counter] = {}
        n_docs: Counter = Counter()
        total: dict[str, np.ndarray] = {}

        def flush() -> None:
            langs = sorted(seen)
            place: dict[str, int] = {}
            cells = []
            for j, lang in enumerate(langs):
                for run_, n in seen[lang].items():
                    for word in marked(run_):
                        cells.append((place.setdefault(word, len(place)), j, n))
            if cells:
                counts = np.zeros((len(place), len(langs)))
                at = np.array(cells)
                np.add.at(counts, (at[:, 0], at[:, 1]), at[:, 2])
                found = expected_counts(vocab, list(place), counts)
                for j, lang in enumerate(langs):
                    total[lang] = total.get(lang, 0) + found[:, j]
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                seen.setdefault(lang, Counter()).update(words_of(text))
                n_docs[lang] += 1
                if sum(map(len, seen.values())) > REMEMBERED:
                    flush()
        flush()
        for lang, n in n_docs.items():
            use = total.get(lang, np.zeros(vocab.size))
            at = np.flatnonzero(use)
            yield pd.DataFrame({"lang": lang, "piece": np.concatenate([[-1], at]), "uses": np.concatenate([[float(n)], use[at]])})

    partial = rows.mapInPandas(run, "lang string, piece int, uses double")
    found = partial.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
    langs = sorted(found["lang"].unique())
    uses = np.full((len(pieces) + 1, len(langs)), SMOOTHING)
    docs_of = np.zeros(len(langs))
    for j, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        inside = own[own["piece"] >= 0]
        uses[inside["piece"].to_numpy(), j] += inside["uses"].to_numpy()
        docs_of[j] = own[own["piece"] < 0]["uses"].sum()
    prior = np.log(docs_of / max(docs_of.sum(), 1.0)) if langs else docs_of
    return Model(langs, prior, uses / uses.sum(axis=0, keepdims=True), pieces)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held (passed on), lang_pred, score for every row, from the text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        vocab, n_lang = Pieces(m.pieces), max(1, len(m.langs))
        place: dict[str, int] = {}
        table = np.zeros((0, n_lang))
        lettered = np.zeros(0, dtype=bool)
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 2000):
                if len(place) > REMEMBERED:
                    place, table, lettered = {}, np.zeros((0, n_lang)), np.zeros(0, dtype=bool)
                counted = [Counter(words_of(t)) if t else Counter() for t in texts[at : at + 2000]]
                new = list({w for c in counted for w in c if w not in place})
                if new:
                    parts, owner = [], []
                    for i, run_ in enumerate(new):
                        place[run_] = len(place)
                        for word in marked(run_):
                            parts.append(word)
                            owner.append(i)
                    logs = np.zeros((len(new), n_lang))
                    if parts and m.langs:
                        np.add.at(logs, owner, log_likelihoods(vocab, m.probs, parts))
                    table = np.concatenate([table, logs])
                    lettered = np.concatenate([lettered, np.isin(np.arange(len(new)), owner)])
                preds, scores = [], []
                for c in counted:
                    ids = np.fromiter((place[w] for w in c), dtype=np.int64, count=len(c))
                    if not m.langs or not len(ids) or not lettered[ids].any():
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    total = np.fromiter(c.values(), dtype=float, count=len(c)) @ table[ids] + m.prior
                    best = int(np.argmax(total))
                    preds.append(m.langs[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[at : at + 2000].to_numpy(), "held_out": batch["held_out"].iloc[at : at + 2000].to_numpy(),
                    "lang_pred": preds, "score": scores})

    return docs.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, path: str, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Learn from the documents outside the held-out part, predict all."""
    held = held_out(modulus, remainder)
    model = learn(docs.where(~held), path)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return predict(every, model)
