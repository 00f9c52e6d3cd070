"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

Encoder.  An Aho-Corasick automaton over the reversed tokens names, in one pass over a
reversed word, the longest token that starts at each position.  The encoder walks from left
to right with that token, falls back to the next shorter one, and gives up a position for
good when no token leads on from it, so it visits each position a bounded number of times.
A step is allowed only if the pair of neighbouring tokens is compatible: the merges of the
two tokens, undone one after the other, must show no earlier merge across their border.
Every sequence of pairwise compatible tokens is the one that the merge rules give.

Decoder.  The tokens' characters lie in one buffer; ids index a table of offsets into it.

Text rules (normal form, white space, case, splitting) come with the vocabulary file.  For
texts of plain Latin characters they are spelled out here; all other texts pass through the
file's own normaliser and splitter.  Words are encoded once and remembered in a table of
bounded size.

Defined results: a null text is an empty one, with no ids; the strings of special tokens in
a text give their ids; repeated rows are encoded alike; an empty table gives no rows.  Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words remembered per Python worker before the table is emptied.
REMEMBERED = 300_000
END = "\n"  # stands for the end-of-word mark; no byte maps to it

# The characters that byte-level vocabularies use for the 256 bytes.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in set(_PRINTABLE)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}

# Characters whose normal form, case and class need no table: Latin letters that lower-case
# to one letter, digits, ASCII signs and white space.
_PLAIN = re.compile("[\\t-\\r -~À-ÖØ-öø-įı-ňŊ-ž]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\\sa-z0-9ß-öø-ž]+")


class _Words(dict):
    """Words met so far."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str):
        found = self[word] = self.vocab._piece(word, False)
        return found


def joined(pieces: list[tuple[tuple[int, ...], str]]) -> np.ndarray:
    return np.array([i for ids, _ in pieces for i in ids], dtype=np.int64)


class Vocabulary:
    """One vocabulary file with its tables for encoding and decoding."""

    def __init__(self, content: bytes):
        import ahocorasick
        from tokenizers import Tokenizer

        model = json.loads(content)
        suffix = model["model"]["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_buffer(content)
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

        vocab = model["model"]["vocab"]
        self.ids: dict[str, int] = {self._marked(t, suffix): i for t, i in vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        # Rank of a token: the merge that makes it; characters come before all merges.
        self.pair: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {i: (i, i) for i in self.ids.values()}
        self.rank: dict[int, int] = dict.fromkeys(self.ids.values(), -1)
        for k, (a, b) in enumerate(merges):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((left, right), k)
            if self.rank[both] < 0:
                self.rank[both], self.split[both] = k, (left, right)

        automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            automaton.add_word(token[::-1], (len(token), i))
        automaton.make_automaton()
        self.automaton = automaton
        self.length = {i: len(t) for t, i in self.ids.items()}
        self.shorter = {i: self._shorter(t) for t, i in self.ids.items()}

        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        parts = [np.frombuffer(names.get(i, "").encode("utf-32-le"), dtype=np.uint32) for i in range(max(names) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.buffer = np.concatenate(parts)
        self.words = _Words(self)

    @staticmethod
    def _marked(token: str, suffix: str) -> str:
        return token[: -len(suffix)] + END if suffix and token.endswith(suffix) and token != suffix else token

    def _shorter(self, token: str) -> int:
        """The longest proper prefix that is a token, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ids.get(token[:n])) is not None:
                return i
        return -1

    def compatible(self, left: int, right: int) -> bool:
        """Does no merge cross the border of ``left`` and ``right`` before both are whole?

        The two tokens are undone from the latest merge backwards.  A pair that meets at the
        border and has a merge of its own must be younger than what was just undone.
        """
        rank, split, pair = self.rank, self.split, self.pair
        limit = 1 << 60
        while True:
            k = pair.get((left, right))
            if k is not None and k < limit:
                return False
            # Undo the younger of the two; on a tie the left one wins, as merges run leftmost first.
            if rank[left] > rank[right]:
                limit, left = rank[left], split[left][1]
            elif rank[right] >= 0:
                limit, right = rank[right] + 1, split[right][0]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as the characters of its bytes and the end mark."""
        n = len(word)
        longest = [-1] * n
        width = [0] * n
        for end, (size, i) in self.automaton.iter(word[::-1]):
            at = n - 1 - end
            if size > width[at]:
                width[at], longest[at] = size, i
        whole = longest[0]
        if width[0] == n and self.rank[whole] < 0:
            return [whole]
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                after = at + self.length[token]
                if not dead[after] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = after
                token = longest[at] if at < n else -1
                continue
            dead[at] = 1
            if not out:
                raise ValueError(f"no encoding of {word!r}")
            token = out.pop()
            at -= self.length[token]
            token = self.shorter[token]
        return out

    def _piece(self, word: str, mapped: bool) -> tuple[tuple[int, ...], str]:
        """Ids of a word and the same as decimal numbers."""
        if not mapped:
            word = "".join(map(BYTE_CHARS.__getitem__, word.encode()))
        ids = tuple(self.encode_word(word + END))
        return ids, " ".join(map(str, ids))

    def _pieces(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if _PLAIN.fullmatch(text):
            known = self.words
            return [known[w] for w in _WORDS.findall(text.lower())]
        normal = self.library.normalizer.normalize_str(text)
        return [self._piece(w, True) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """Ids and decimal numbers of the words and special tokens of a text, in order."""
        if self._special is None or "<" not in text:
            return self._pieces(text)
        out = []
        for piece in self._special.split(text):
            if piece in self.specials:
                out.append(((self.specials[piece],), str(self.specials[piece])))
            elif piece:
                out.extend(self._pieces(piece))
        return out

    def encode(self, text: str) -> np.ndarray:
        return joined(self.pieces(text))

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by one blank, as a file without a decoder asks for."""
        if not len(ids):
            return ""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        places = np.cumsum(sizes + 1) - sizes - 1
        out = np.full(int(sizes.sum()) + len(ids) - 1, 0x20, dtype=np.uint32)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(places, sizes) + inside] = self.buffer[np.repeat(starts, sizes) + inside]
        return out.tobytes().decode("utf-32-le")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """Built once per Python worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every document.  The file is shipped with the job (a few MB)."""
    shipped = docs.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(shipped.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [vocab.encode(t or "") for t in batch["text"]]})

    return _narrow(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of encoded documents."""
    shipped = encoded.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(shipped.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [vocab.decode(np.asarray(i, dtype=np.int64)) for i in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(docs: DataFrame, path: str, with_ids: bool) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(shipped.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                pieces = vocab.pieces(text or "")
                ids = joined(pieces)
                decimal = " ".join([d for _, d in pieces])
                row = (doc_id, len(ids), hashlib.sha256(decimal.encode()).hexdigest(),
                       hashlib.sha256(vocab.decode(ids).encode()).hexdigest())
                rows.append((*row, ids.astype(np.int32)) if with_ids else row)
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
            yield out.astype({"doc_id": "Int64"})

    return _narrow(docs).mapInPandas(run, DIGEST + ", ids array<int>" * with_ids)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode again, and keep counts and digests of both, in one pass over the texts."""
    return _digested(docs, path, False)


def encoded_with_digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``digests``, with the ids."""
    return _digested(docs, path, True)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
