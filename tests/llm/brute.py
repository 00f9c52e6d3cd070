"""Plain versions of the operators for small tables."""

import hashlib
import math
import re
from collections import Counter


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


FORMS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(FORMS) for m in rx.finditer(text) if ok(m))


def entropy(window):
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def groups(rows, width, percent=80):
    """doc_id: (set size, component) by comparing all pairs."""
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def without_repeats(rows, size):
    enc = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + size] for _, b in enc for k in range(len(b) - size + 1))
    out = {}
    for i, b in enc:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\x01" * size
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, sha(kept))
    return out


def merkle(rows):
    """One tuple (leaf, subroot, root, proof, folded, tree place) per (doc_id, source, lang, n_chars, text), in tree order."""
    import zlib

    def leaf(row):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))

    def climb(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
        return out

    def path(rows, at):
        for low in rows[:-1]:
            other = at ^ 1
            yield (low[other], "") if other < at else ("", low[other] if other < len(low) else "")
            at //= 2

    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    levels = {x: climb([leaf(r) for r in trees[x]]) for x in langs}
    top = climb([levels[x][-1][0] for x in langs]) if langs else []
    out = []
    for place, x in enumerate(langs):
        for at, row in enumerate(trees[x]):
            steps = [*path(levels[x], at), *path(top, place)]
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node = leaf((*row[:3], row[3] + 1, row[4])) if bad else leaf(row)
            for a, b in steps:
                node = sha(a + node + b)
            out.append((row[0], leaf(row), levels[x][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


def simhash64(text, width):
    import xxhash

    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(codes, radius):
    """Smallest code reachable from every code by steps within the radius, comparing all pairs."""
    codes = sorted(set(codes))
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(codes):
        for b in codes[:k]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def hard_negatives(rows, is_anchor):
    """Contract rows of (vec_id, label, vector) by scoring every anchor with every row."""
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and abs(x) < 2**20 for x in v)]
    out = []
    for n, (i, lab, a) in enumerate(rows):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j, other) for m, (j, other, b) in enumerate(rows) if m != n)
        for p, pid, _ in [s for s in scored if s[2] == lab][:5]:
            fits = [(-s, j) for s, j, other in scored if other != lab and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(i, pid, k, j, -p, s) for k, (s, j) in enumerate(fits[:3], 1)]
    return sorted(out)
