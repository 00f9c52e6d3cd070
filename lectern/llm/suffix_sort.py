"""Suffix arrays by induced sorting, and permuted common prefixes, with numpy.

``suffix_array`` classifies suffixes as smaller or larger than the next one, sorts the
leftmost smaller substrings by inducing, names them, ranks the reduced string of names and
induces the full order from it.  Inducing runs bucket by bucket; within a bucket all entries
known so far are handled at once, so the work is linear and vectorised.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol is a unique smallest one."""
    step = np.sign(np.diff(text))
    n = len(text)
    known = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(known[::-1])[::-1]  # next position where neighbours differ
    smaller = np.ones(n, dtype=bool)
    smaller[:-1] = np.append(step, 1)[nxt] > 0
    return smaller


def _induce(text: np.ndarray, smaller: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost smaller ones in ``order``."""
    n, n_sym = len(text), len(starts) - 1
    out = np.full(n, -1, dtype=np.int64)
    seeds = order[np.argsort(text[order], kind="stable")]
    seed_at = np.searchsorted(text[seeds], np.arange(n_sym + 1))
    head, tail = starts[:-1].copy(), starts[1:].copy()

    def put(pos: np.ndarray, ends: np.ndarray, forward: bool) -> None:
        syms = text[pos]
        by = np.argsort(syms, kind="stable")
        pos, syms = pos[by], syms[by]
        first = np.flatnonzero(np.append(True, syms[1:] != syms[:-1]))
        sizes = np.diff(np.append(first, len(syms)))
        rank = np.arange(len(syms)) - np.repeat(first, sizes)
        at = ends[syms] + rank if forward else ends[syms] - 1 - rank
        out[at] = pos
        ends[syms[first]] += sizes if forward else -sizes

    used = [int(c) for c in np.flatnonzero(np.diff(starts))]
    for c in used:  # larger suffixes, from the left
        done = int(starts[c])
        while done < head[c]:
            batch = out[done : head[c]]
            done = int(head[c])
            before = batch[batch > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                put(before, head, True)
        batch = seeds[seed_at[c] : seed_at[c + 1]]
        before = batch[batch > 0] - 1
        if len(before):
            put(before[~smaller[before]], head, True)
    for c in reversed(used):  # smaller suffixes, from the right
        done = int(starts[c + 1])
        while done > tail[c]:
            batch = out[tail[c] : done][::-1]
            done = int(tail[c])
            before = batch[batch > 0] - 1
            before = before[smaller[before]]
            if len(before):
                put(before, tail, False)
        batch = out[starts[c] : head[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[smaller[before]]
        if len(before):
            put(before, tail, False)
    out[0] = n - 1
    return out


def _rank_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the reduced string: pairs of names become names, doubled each time."""
    rank, width = names, 1
    while True:
        second = np.zeros(len(rank), dtype=np.int64)
        second[:-width] = rank[width:] + 1
        pair = rank * (int(rank.max()) + 2) + second
        order = np.argsort(pair, kind="stable")
        new = np.empty(len(rank), dtype=np.int64)
        new[order] = np.cumsum(np.append(0, np.diff(pair[order]) != 0))
        rank, width = new, 2 * width
        if rank[order[-1]] == len(rank) - 1 or width >= len(rank):
            return order


class Prefixes:
    """Hashes of any substring of a symbol string, for comparing many at once."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, text: np.ndarray):
        n = len(text)
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, self.BASE, dtype=np.uint64)))
            back = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, pow(self.BASE, -1, 1 << 64), dtype=np.uint64)))
            spread = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            spread ^= spread >> np.uint64(29)
            self.total = np.append(np.uint64(0), np.add.accumulate(spread * self.power[:n]))
        self.back = back

    def of(self, at: np.ndarray, size) -> np.ndarray:
        return (self.total[at + size] - self.total[at]) * self.back[at]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order.  Symbols are small whole numbers, 0 is the end mark."""
    text = np.append(np.asarray(text, dtype=np.int64) + 1, 0)
    n = len(text)
    starts = np.append(0, np.cumsum(np.bincount(text)))
    smaller = _types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    first = _induce(text, smaller, lms, starts)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    sorted_lms = first[is_lms[first]]
    # Equal substrings from one leftmost smaller position to the next get one name.
    size = np.ones(n, dtype=np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    hashes = Prefixes(text).of(sorted_lms, size[sorted_lms])
    same = (hashes[1:] == hashes[:-1]) & (size[sorted_lms[1:]] == size[sorted_lms[:-1]])
    name = np.empty(n, dtype=np.int64)
    name[sorted_lms] = np.cumsum(np.append(0, ~same))
    reduced = name[lms]
    order = lms[_rank_names(reduced)] if same.any() else sorted_lms
    return _induce(text, smaller, order, starts)[1:]


def permuted_prefixes(text: np.ndarray, order: np.ndarray, longest: int) -> np.ndarray:
    """By position: the common prefix with the suffix before it in order, up to ``longest``.

    All positions are compared at once, by halving steps over substring hashes.
    """
    before = np.full(len(text), -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    hashes, n = Prefixes(text), len(text)
    found = np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(before >= 0)
    step = 1 << (longest.bit_length() - 1)
    while step:
        a, b = at + found[at], before[at] + found[at]
        fits = (np.maximum(a, b) + step <= n) & (found[at] + step <= longest)
        a, b, own = a[fits], b[fits], at[fits]
        found[own[hashes.of(a, step) == hashes.of(b, step)]] += step
        step >>= 1
    return found
