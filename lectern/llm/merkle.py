"""Merkle dataset manifest: leaves, roots, inclusion proofs and their check (cogrouped subtree exchange).

A row's leaf is the digest of its fields.  Per tree (language) leaves lie in the order of their
ids; every ``FAN`` neighbours become their digest until one node, the subroot, remains.  The
subroots, in the order of their languages, become the root by the same rule.  A digest is the
lowercase hexadecimal SHA-256 of its inputs put together, digests as hexadecimal text.

Leaves are numbered by sampled ranges, so a language that holds any share of the rows spreads
over all tasks, and are cut into superblocks of ``FAN**LEVELS`` neighbours.  First every superblock
is reduced to its top node.  The tops are the leaves of a tree ``FAN**LEVELS`` times smaller, which
is climbed in the same way, superblock by superblock, up to the root; so no task ever holds
more than a superblock.  Then each superblock needs one node more per level above it: these
outer siblings, one row each, are cogrouped with its leaves by (tree, superblock).  That one
function call finishes the local reduction, joins the local and outer part of every leaf's
proof and folds every leaf up to the root, hashing the tampered leaf where there is one.

Defined results: null fields are ``-``, so a null and an empty text differ; a null language is
a tree of its own, the first one; null ids come first and are never tampered with; rows of one
id lie in the order of their leaves, so repeated rows are neighbours with proofs of their own;
a lone leaf is its subroot, a lone subroot is the root, and the proof of a lone leaf in a lone
tree is the digest of nothing; texts of any length are hashed whole; an empty table gives no
rows.  Only the columns ``FIELDS`` are read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import cut
from lectern.operators.ordered import number_sorted

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 2
#: Levels of a superblock, the unit that one task holds: it has ``FAN**LEVELS`` leaves.
LEVELS = 10
STEP = "tree string, pos long, step int, before string, after string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def levels(n: int) -> int:
    """How often ``n`` nodes are reduced until one remains."""
    return (int(n) - 1).bit_length()


def reduce_nodes(nodes: list[str], times: int) -> list[list[str]]:
    """The nodes of every level, from ``nodes`` up; a last node without neighbours is hashed alone."""
    out = [nodes]
    for _ in range(times):
        low = out[-1]
        out.append([digest("".join(low[k : k + FAN])) for k in range(0, len(low), FAN)])
    return out


def siblings(rows: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Of the node ``at`` of the lowest level: what stands before and after it in its run, level by level."""
    out = []
    for low in rows[:-1]:
        first = at - at % FAN
        out.append(("".join(low[first:at]), "".join(low[at + 1 : first + FAN])))
        at //= FAN
    return out


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(fields[c]) for c in FIELDS]).cast("binary"), 256)


def _block(pos: str, depth: int) -> Column:
    return F.floor(F.col(pos) / FAN**depth)


def tree_key(lang: Column) -> Column:
    """A text that sorts like the language, nulls first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def leaves(docs: DataFrame, tampered: Column | None = None, changes: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, tree, leaf, other of every row; ``other`` is the leaf after ``changes`` to rows that are ``tampered``."""
    fields = {c: F.col(c) for c in FIELDS}
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(fields | (changes or {})))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree_key(F.col("lang")).alias("tree"),
                       leaf(fields).alias("leaf"), other.alias("other"))


def numbered(hashed: DataFrame, depth: int) -> DataFrame:
    """Leaves with ``pos``, their place in the tree from 0, ``block`` and ``n``, the size of their tree."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("other").asc_nulls_first()]
    placed = number_sorted(hashed, ["tree"], order, "pos").withColumn("pos", F.col("pos") - 1)
    sizes = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(sizes, "tree").withColumn("block", _block("pos", depth))


def tops(nodes: DataFrame, depth: int) -> DataFrame:
    """tree, pos, n, leaf: the top node of every superblock, as a node of the next smaller tree."""

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        own = rows.sort_values("pos")["leaf"].tolist()
        return pd.DataFrame({"tree": [key[0]], "pos": [int(key[1])], "n": [-(-n // FAN**depth)],
                             "leaf": [reduce_nodes(own, min(depth, levels(n)))[-1][0]]})

    return nodes.select("tree", "block", "pos", "n", "leaf").groupBy("tree", "block").applyInPandas(
        top, "tree string, pos long, n long, leaf string")


def _local_steps(nodes: DataFrame, depth: int) -> DataFrame:
    """``STEP`` rows inside the superblock of every node."""

    def steps(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        reduced = reduce_nodes(rows["leaf"].tolist(), min(depth, levels(rows["n"].iloc[0])))
        out = [(key[0], int(pos), k, *pair) for at, pos in enumerate(rows["pos"]) for k, pair in enumerate(siblings(reduced, at))]
        return pd.DataFrame(out, columns=["tree", "pos", "step", "before", "after"])

    return nodes.groupBy("tree", "block").applyInPandas(steps, STEP)


def climb(nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """``STEP`` rows of every node (tree, pos, n, leaf) up to the top of its tree, and the tops (tree, leaf).

    Each round works on a table ``FAN**depth`` times smaller; ``n`` says on the driver when one
    node per tree is left.
    """
    steps, below, height = None, None, 0
    while True:
        largest = nodes.agg(F.max("n")).first()[0] or 1
        nodes = nodes.withColumn("block", _block("pos", depth))
        own = _local_steps(nodes, depth).withColumn("step", (F.col("step") + height).cast("int"))
        # Every node of the first round gets the steps of the superblocks above it.
        mine = nodes.select("tree", F.col("pos").alias("_at"), "pos") if below is None else below
        own = mine.join(own, ["tree", "pos"]).select("tree", F.col("_at").alias("pos"), "step", "before", "after")
        steps = own if steps is None else steps.unionByName(own)
        below = mine.withColumn("pos", _block("pos", depth))
        nodes, height = cut(tops(nodes, depth), "tops"), height + depth
        if largest <= FAN**depth:
            return steps, nodes.select("tree", "leaf")


def proofs(hashed: DataFrame, depth: int = LEVELS) -> DataFrame:
    """doc_id, tree, pos, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``leaves``.

    ``folded_root`` is what ``other``, where it is there, or the leaf folds to with the siblings
    of the untouched tree.
    """
    placed = cut(numbered(hashed, depth), "leaves")
    blocks = cut(tops(placed, depth), "tops")
    inner, subroots = climb(blocks, depth)
    subroots = cut(number_sorted(subroots, [], [F.col("tree")], "pos").withColumn("pos", F.col("pos") - 1), "subroots")
    forest = subroots.select(F.lit("").alias("tree"), "pos", F.lit(subroots.count()).cast("long").alias("n"), "leaf")
    upper, top = climb(forest, depth)
    found = top.first()
    root = F.lit(found["leaf"] if found else None).cast("string")
    # One row per superblock and level above it, and one with subroot and root.
    at = blocks.select("tree", F.col("pos").alias("block"))
    of_tree = subroots.select("tree", "pos", F.col("leaf").alias("subroot"))
    inner = inner.withColumnRenamed("pos", "block").withColumn("part", F.lit(1))
    upper = upper.select("pos", "step", "before", "after").join(of_tree.select("tree", "pos"), "pos").join(at, "tree").select(
        "tree", "block", "step", "before", "after", F.lit(2).alias("part"))
    ends = of_tree.join(at, "tree").select(
        "tree", "block", F.lit(0).alias("step"), F.col("subroot").alias("before"), root.alias("after"), F.lit(0).alias("part"))
    outer = ends.unionByName(inner).unionByName(upper)

    def finish(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        above = above.sort_values(["part", "step"])
        subroot, root = above["before"].iloc[0], above["after"].iloc[0]
        rest = list(zip(above["before"].iloc[1:], above["after"].iloc[1:]))
        reduced = reduce_nodes(rows["leaf"].tolist(), min(depth, levels(rows["n"].iloc[0])))
        proved, folded = [], []
        for at, (own, other) in enumerate(zip(rows["leaf"], rows["other"])):
            path = siblings(reduced, at) + rest
            proved.append(digest("".join(a + b for a, b in path)))
            node = other if isinstance(other, str) else own
            for before, after in path:
                node = digest(before + node + after)
            folded.append(node)
        return pd.DataFrame({
            "doc_id": rows["doc_id"].astype("Int64"), "tree": key[0], "pos": rows["pos"], "leaf": rows["leaf"], "subroot": subroot,
            "root": root, "proof_sha256": proved, "folded_root": folded, "verified": [x == root for x in folded]})

    return placed.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        finish, "doc_id long, tree string, pos long, leaf string, subroot string, root string, proof_sha256 string, "
                "folded_root string, verified boolean")


def tampered_by_checksum(docs: DataFrame, divisor: int = 7) -> DataFrame:
    """Leaves of ``docs`` where every row whose id's checksum ``divisor`` divides has one more in ``n_chars``."""
    marked = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % divisor == 0, F.lit(False))
    return leaves(docs, marked, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
