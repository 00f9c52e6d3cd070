"""Does a dictionary of a checked size hold a string?  A probe inside an expression, without a join.

The dictionary becomes one array of 64-bit words, a bit table that two hashes of every entry
set, and travels as a constant of the plan.  A probe never misses an entry; of the strings
that are none it lets pass about one in a thousand, so what passes still meets the dictionary
in an exact join.  Text that matches nothing is dropped where it lies, before it is unnested.
"""

from __future__ import annotations

import itertools
import json
import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries up to which a table is made (256 KB of bits); a larger dictionary has none.
MOST_ENTRIES = 50_000
#: Bits per entry.
ROOM = 40


class Probe:
    """``probe(text)`` is true for every entry; without a table it is true for everything."""

    def __init__(self, words: list[int] | None):
        self.size = 64 * len(words) if words else 0
        # Cast from one text constant: folded to an array once per plan.
        self.table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>") if words else None

    def __call__(self, text: Column) -> Column:
        if self.table is None:
            return F.lit(True)
        own = F.xxhash64(text)

        def is_set(bit: Column) -> Column:
            word = F.element_at(self.table, (F.shiftright(bit, 6) + 1).cast("int"))
            return F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1

        low, high = self._places(own)
        return is_set(low) & is_set(high)

    def _places(self, own: Column) -> tuple[Column, Column]:
        return _places(own, self.size)


def strings(entries: list[str]) -> Column:
    """The entries as one constant array."""
    return F.from_json(F.lit(json.dumps(entries)), "array<string>")


class Listed:
    """``listed(text)``: the whole numbers filed under a string, and now and then some more.

    Strings meet in ``slots`` by their hash; the numbers of all slots lie in one array, and a
    second one says where each slot's numbers start.  A string that is not filed mostly gets
    an empty list.
    """

    def __init__(self, filed: dict[int, list[int]], slots: int):
        starts, values = [0], []
        for slot in range(slots):
            values += filed.get(slot, [])
            starts.append(len(values))
        constant = lambda xs: F.split(F.lit(",".join(map(str, xs or [0]))), ",").cast("array<int>")
        self.slots, self.starts, self.values = slots, constant(starts), constant(values)

    def __call__(self, text: Column) -> Column:
        slot = F.xxhash64(text).bitwiseAND(F.lit(self.slots - 1).cast("bigint")).cast("int")
        start, end = F.element_at(self.starts, slot + 1), F.element_at(self.starts, slot + 2)
        return F.slice(self.values, start + 1, end - start)


#: Entries, and characters of all and of one entry, up to which a tree pattern is made.
MOST_BRANCHED, MOST_TREE, LONGEST_BRANCH = 5_000, 200_000, 500


def listed_entries(entries: DataFrame, column: str) -> list[str] | None:
    """The distinct filled strings of ``column`` in order; None when a tree of them gets too large."""
    known = entries.select(F.col(column).alias("_e")).where(F.col("_e") != "").distinct()
    out = sorted(r["_e"] for r in known.limit(MOST_BRANCHED + 1).collect())
    small = len(out) <= MOST_BRANCHED and sum(map(len, out)) <= MOST_TREE and max(map(len, out), default=0) <= LONGEST_BRANCH
    return out if small else None


def tree_pattern(entries: list[str], gap: tuple[str, str] | None = None) -> str:
    """Java pattern of the longest entry that stands at a place.

    ``gap`` says what a space of an entry stands for: what one may start with, as part of a
    character class, and its pattern.

    Entries share what they have in common at the start, so a place is tried with one
    character of few branches, not with every entry.  Of the entries at a place, all others
    are the start of the longest (see :func:`starts_of`).
    """
    start, space = gap or (r"\x{20}", r"\x{20}")
    plain = lambda c: c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"
    literal = lambda s: "".join(space if c == " " else plain(c) for c in s)

    def branch(own: list[str], at: int) -> str:
        ends = len(own[0]) == at
        ways = []
        for first, more in itertools.groupby(own[ends:], key=lambda e: e[at]):
            part = list(more)
            head = len(os.path.commonprefix([part[0], part[-1]]))
            ways.append((start if first == " " else plain(first), literal(part[0][at:head]) + branch(part, head)))
        if not ways:
            return ""
        width = max(6, math.isqrt(len(ways)))
        if len(ways) > width:  # a class of first characters leads to each bundle of branches
            bundles = [ways[k : k + width] for k in range(0, len(ways), width)]
            ways = [(None, f"(?=[{''.join(c for c, _ in b)}])(?:{'|'.join(w for _, w in b)})") for b in bundles]
        return f"(?:{'|'.join(w for _, w in ways)})" + "?" * ends

    return branch(sorted(set(entries)), 0)


def starts_of(entries: list[str], end: str = "") -> list[tuple[str, str]]:
    """(entry, another that it starts with, or itself); in the entry ``end`` follows the other."""
    known = set(entries)
    return [
        (whole, whole[:n]) for whole in known for n in range(1, len(whole) + 1)
        if whole[:n] in known and (n == len(whole) or whole.startswith(end, n))
    ]


def listed(spark: SparkSession, filed: dict[str, list[int]]) -> Listed:
    """A :class:`Listed` of a dictionary whose size the caller has checked."""
    slots = 64
    while slots < 8 * len(filed):
        slots *= 2
    keys = spark.createDataFrame([(k,) for k in filed], "k string")
    slot = F.xxhash64("k").bitwiseAND(F.lit(slots - 1).cast("bigint"))
    out: dict[int, list[int]] = {}
    for row in keys.select("k", slot.alias("slot")).collect():
        out[row.slot] = sorted({*out.get(row.slot, []), *filed[row.k]})
    return Listed(out, slots)


def _places(own: Column, size: int) -> tuple[Column, Column]:
    last = F.lit(size - 1).cast("bigint")
    return own.bitwiseAND(last), F.shiftrightunsigned(own, 32).bitwiseAND(last)


def probe_of(entries: DataFrame, column: str) -> Probe:
    """A probe of the distinct strings in ``column``; one bounded pass counts them first."""
    known = entries.select(F.col(column).alias("_e")).where(F.col("_e").isNotNull()).distinct()
    n = known.limit(MOST_ENTRIES + 1).count()
    if n > MOST_ENTRIES:
        return Probe(None)
    size = 64
    while size < ROOM * n:
        size *= 2
    places = _places(F.xxhash64("_e"), size)
    bits = known.select(F.explode(F.array(*places)).alias("bit"))
    # At most two bits per entry come to the driver, gathered in words.
    held = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    ).collect()
    words = [0] * (size // 64)
    for row in held:
        words[row.word] = row.bits
    return Probe(words)
