"""Range, as-of, coverage and membership joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.probe import strings
from lectern.operators.ordered import carry, carry_sorted


#: Pieces up to which a range table is looked up inside the row.
FEW_PIECES = 4096


def flatten_ranges(ranges: DataFrame) -> DataFrame:
    """Disjoint pieces (start, hit) of overlapping ranges; ``hit`` is the first range there, or null.

    The first range is the one with the least ``position``.  A piece goes up to the next
    start.  The winner at each end point is found without listing what a range covers: a
    range is at most two binary intervals per size, an end point lies in one of each size,
    and the two meet by size and number.
    """
    kept = ranges.where("lo <= hi").select(
        F.col("lo").cast("bigint").alias("lo"), F.least(F.col("hi").cast("bigint"), F.lit(2**63 - 2)).alias("hi"),
        F.struct("position", "lo", "hi", "slug", "title").alias("hit"),
    )
    sizes = F.sequence(F.lit(0), F.lit(62))
    shift = lambda n, by: F.call_function("shiftright", n, by)
    node = lambda size, at: F.struct(size.alias("size"), at.alias("at"))

    def intervals(size: Column) -> Column:
        first, end = -shift(-F.col("lo"), size), shift(F.col("hi") + 1, size)
        odd = lambda n: n.bitwiseAND(F.lit(1)) == 1
        return F.array_compact(F.array(
            F.when((first < end) & odd(first), node(size, first)), F.when((first < end) & odd(end), node(size, end - 1))
        ))

    covered = kept.select("hit", F.explode(F.flatten(F.transform(sizes, intervals))).alias("n")).select("hit", "n.*")
    points = kept.select(F.explode(F.array(F.col("lo"), F.col("hi") + 1)).alias("start")).distinct()
    around = points.select("start", F.explode(F.transform(sizes, lambda z: node(z, shift(F.col("start"), z)))).alias("n"))
    winners = around.select("start", "n.*").join(covered, ["size", "at"]).groupBy("start").agg(F.min("hit").alias("hit"))
    return points.join(winners, "start", "left")


def assign_ranges(rows: DataFrame, number: str, ranges: DataFrame) -> DataFrame:
    """First range with ``lo <= number <= hi``: adds slug, title and 1-based ordinal.

    The ranges are flattened into disjoint pieces.  A table of a checked number of pieces is
    searched by halves inside the row; a larger one is stacked with the rows, and each piece
    is carried forward to the numbers that follow it.  Rows outside every range keep nulls.
    """
    pieces = flatten_ranges(ranges)
    few = pieces.select("start", "hit.slug", "hit.title", "hit.lo").limit(FEW_PIECES + 1).collect()
    value = F.col(number).cast("bigint")
    if len(few) <= FEW_PIECES:
        few.sort(key=lambda r: r["start"])
        whole = lambda field: F.split(F.lit(",".join(str(r[field] or 0) for r in few) or "0"), ",").cast("array<bigint>")
        starts, lows = whole("start"), whole("lo")

        def halve(at: Column, _: Column) -> Column:
            middle = F.shiftright(at["low"] + at["high"] + 1, 1)
            below = F.coalesce(F.get(starts, middle - 1) <= value, F.lit(False))
            return F.struct(
                F.when(below, middle).otherwise(at["low"]).alias("low"),
                F.when(below, at["high"]).otherwise(F.greatest(middle - 1, at["low"])).alias("high"),
            )

        begin = F.struct(F.lit(0).alias("low"), F.lit(len(few)).alias("high"))
        place = F.aggregate(F.sequence(F.lit(0), F.lit(len(few).bit_length())), begin, halve)["low"] - 1
        placed = rows.withColumn("_place", F.when(value.isNotNull(), place))
        slug = F.get(strings([r["slug"] for r in few]), F.col("_place"))
        hit = [slug.alias("slug"), F.get(strings([r["title"] for r in few]), F.col("_place")).alias("title"), F.get(lows, F.col("_place")).alias("_lo")]
        found = placed.select(*rows.columns, *hit)
    else:
        kinds = {f.name: f.dataType for f in rows.schema}
        stacked = rows.withColumn("_at", value).withColumn("_piece", F.lit(None).cast("string")).unionByName(pieces.select(
            F.col("start").alias("_at"), F.to_json(F.struct("hit")).alias("_piece"),
            *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]))
        filled = carry_sorted(stacked, [F.col("_at").asc_nulls_first(), F.col("_piece").isNull(), F.xxhash64(*rows.columns)],
                              {"_held": F.col("_piece")}).where(F.col("_piece").isNull())
        hit = F.from_json("_held", "hit struct<slug:string,title:string,lo:bigint>")["hit"]
        found = filled.select(*rows.columns, hit["slug"].alias("slug"), hit["title"].alias("title"), hit["lo"].alias("_lo"))
    covered = F.col("slug").isNotNull()
    return found.select(
        *rows.columns, "slug", F.when(covered, F.col("title")).alias("title"),
        F.when(covered, F.col(number) - F.col("_lo") + 1).alias("ordinal"),
    )


def asof_anchors(
    hits: DataFrame, anchors: DataFrame, group: Sequence[str], block: int = 4096
) -> DataFrame:
    """Last anchor at or before each hit.

    ``hits`` has (group, location, hit_no), ``anchors`` (group, location, anchor).  Both
    are stacked and the anchor is carried forward: linear, no inequality join.
    """
    stacked = anchors.select(
        *group, "location", F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("hit_no"),
        F.col("anchor").alias("_anchor"),
    ).unionByName(
        hits.select(
            *group, "location", F.lit(1).alias("_kind"), F.col("hit_no").cast("bigint"),
            F.lit(None).cast("string").alias("_anchor"),
        )
    ).withColumn("_block", F.floor(F.col("location") / block))
    filled = carry(
        stacked, group, "_block", [F.col("location"), F.col("_kind"), F.col("_anchor")],
        {"anchor": F.col("_anchor")},
    )
    return filled.where((F.col("_kind") == 1) & F.col("anchor").isNotNull()).select(
        *group, "hit_no", "location", "anchor"
    )


def distinct_in_hit_order(matched: DataFrame, group: Sequence[str]) -> DataFrame:
    """Distinct anchors; ``first_hit`` gives the order in which they were first hit."""
    return matched.groupBy(*group, "anchor").agg(F.min("hit_no").alias("first_hit"))


def coverage_diff(expected: DataFrame, received: DataFrame, scope: str, key: str) -> DataFrame:
    """Ids missing, extra or repeated within a scope; both sides are counted first."""
    want = expected.groupBy(scope, key).agg(F.count(F.lit(1)).alias("n_expected"))
    got = received.groupBy(scope, key).agg(F.count(F.lit(1)).alias("n_received"))
    both = want.join(got, [scope, key], "full_outer").select(
        scope, key, F.coalesce("n_expected", F.lit(0)).alias("n_expected"),
        F.coalesce("n_received", F.lit(0)).alias("n_received"),
    )
    status = (
        F.when(F.col("n_received") == 0, "missing")
        .when(F.col("n_expected") == 0, "extra")
        .when(F.col("n_received") > F.col("n_expected"), "duplicate")
        .otherwise("ok")
    )
    return both.withColumn("status", status)


def order_mismatch(
    expected: DataFrame, received: DataFrame, scope: str, key: str
) -> DataFrame:
    """Scopes whose received ids differ, position by position, from the expected ones."""
    want = expected.select(scope, "ord", F.col(key).alias("_want"))
    got = received.select(scope, "ord", F.col(key).alias("_got"))
    both = want.join(got, [scope, "ord"], "full_outer")
    return both.groupBy(scope).agg(
        F.count_if(~F.col("_want").eqNullSafe(F.col("_got"))).alias("n_different")
    )


def lookup(rows: DataFrame, key: str, dimension: DataFrame, fallback: Column) -> DataFrame:
    """Left equi lookup of ``title`` by slug with a fallback value."""
    names = dimension.select(F.col("slug").alias(key), F.col("title").alias("_title"))
    return rows.join(names, key, "left").withColumn(
        "title", F.coalesce("_title", fallback)
    ).drop("_title")


def not_in(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


def known_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_semi")
