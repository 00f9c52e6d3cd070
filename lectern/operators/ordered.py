"""Ordered operators that stay parallel inside one huge group.

A plain window sorts a whole group in one task.  Here a group is cut into blocks by a
key that follows the order (chapter number div 4096, hour of a timestamp, ...).  Rows
meet only inside their block; each block then contributes one summary row, the few
summary rows of a group are linked by a window, and the result is joined back on
(group, block).  No task ever holds more rows than one block, whatever the group size.

``block`` must never decrease along ``order``; ``carry`` and ``neighbours`` take ascending
order columns.  ``number_sorted`` needs no block: it cuts by sampled ranges of the order itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.session import cut_lineage


def number_sorted(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Exact 1-based row number per group along any order, whatever its values.

    Rows are range partitioned by group and order with boundaries that Spark samples, so a
    hot group, a shared prefix or a single group spreads over all tasks.  Each task numbers
    its own run; only one row per task and group is counted and summed up, and the offsets
    go back by (task, group).  The sorted rows are checkpointed in between: both readers must
    see the same ranges, also after a lost executor.  Only rows that are equal in every order
    column stay together, so ``order`` should end with a unique column.
    """
    keys = [F.col(g).asc_nulls_first() for g in group]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut_lineage(ranged.withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_run", F.shiftright("_id", 33))
    runs = rows.groupBy(*group, "_run").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*(group or [F.lit(0)])).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.select(
        *[F.col(k).alias(f"_k_{k}") for k in [*group, "_run"]],
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_least") + 1).alias("_start"),
    )
    cond = F.lit(True)
    for key in [*group, "_run"]:
        cond = cond & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return rows.join(starts, cond).withColumn(name, F.col("_id") + F.col("_start")).select(*df.columns, name)


def carry_sorted(df: DataFrame, order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """Last non-null value at or before each row along any order of the whole table.

    ``values`` maps new column names to the expressions carried.  Rows are range partitioned
    as in ``number_sorted``; a task hands on its last values, one row per task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = cut_lineage(ranged).withColumn("_run", F.shiftright("_id", 33))
    for name, expr in values.items():
        rows = rows.withColumn(f"_v_{name}", expr)
    upto = W.partitionBy("_run").orderBy("_id").rowsBetween(W.unboundedPreceding, 0)
    local = rows.select("*", *[F.last(f"_v_{name}", ignorenulls=True).over(upto).alias(f"_l_{name}") for name in values])
    edges = rows.groupBy("_run").agg(*[
        F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), F.col("_id"))).alias(f"_e_{name}") for name in values
    ])
    earlier = W.partitionBy(F.lit(0)).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    handed = edges.select("_run", *[F.last(f"_e_{name}", ignorenulls=True).over(earlier).alias(f"_h_{name}") for name in values])
    return local.join(handed, "_run").select(
        *df.columns, *[F.coalesce(f"_l_{name}", f"_h_{name}").alias(name) for name in values])


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    block: Sequence[str],
    order: Sequence[Column],
    name: str = "row_no",
    block_order: Sequence[Column] | None = None,
) -> DataFrame:
    """Exact 1-based row number per group: local number plus the rows of earlier blocks.

    The window over a whole group (or, without a group, over everything) sees one row per
    block only.
    """
    keys = [*group, *block]
    local = df.withColumn("_local", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    by_block = list(block_order) if block_order else [F.col(b).asc() for b in block]
    before = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = before.orderBy(*by_block).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
    )
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    joined = local.join(starts, cond, "inner")
    return joined.withColumn(name, F.col("_start") + F.col("_local")).drop(
        "_local", "_start", *[f"_k_{k}" for k in keys]
    )


def number_by(
    df: DataFrame, group: Sequence[str], number: str, name: str, order: Sequence[Column] = (), bits: int = 21
) -> DataFrame:
    """Exact 1-based row number per group along a 64-bit integer column, whatever its gaps.

    Rows meet in runs of ``2**bits`` numbers, run sizes in runs of ``2**(2 * bits)`` and
    those per group, so each window is bounded by the width of a run, not by the group.
    Rows with equal numbers follow ``order``; null numbers come first.
    """
    rows = df.withColumn("_run", F.shiftright(F.col(number), bits))
    sizes = rows.groupBy(*group, "_run").agg(F.count(F.lit(1)).alias("_rows")).withColumn(
        "_outer", F.shiftright("_run", bits)
    )
    outer = sizes.groupBy(*group, "_outer").agg(F.sum("_rows").alias("_rows"))

    def earlier(keys: Sequence[str], along: str) -> Column:
        before = W.partitionBy(*keys).orderBy(F.col(along).asc_nulls_first())
        return F.coalesce(F.sum("_rows").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    def meet(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
        named = right.select([F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
        cond = F.lit(True)
        for key in keys:
            cond = cond & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
        return left.join(named, cond).drop(*[f"_k_{key}" for key in keys])

    outer = outer.select(*group, "_outer", earlier(group, "_outer").alias("_before"))
    inner = sizes.withColumn("_inside", earlier([*group, "_outer"], "_run"))
    starts = meet(inner, outer, [*group, "_outer"]).select(
        *group, "_run", (F.col("_before") + F.col("_inside")).alias("_start")
    )
    along = W.partitionBy(*group, "_run").orderBy(F.col(number).asc_nulls_first(), *order)
    local = rows.withColumn("_local", F.row_number().over(along))
    return meet(local, starts, [*group, "_run"]).withColumn(
        name, F.col("_start") + F.col("_local")
    ).drop("_run", "_start", "_local")


def carry(
    df: DataFrame,
    group: Sequence[str],
    block: str,
    order: Sequence[Column],
    values: dict[str, Column],
    backward: bool = False,
) -> DataFrame:
    """Last non-null value at or before each row (at or after it when ``backward``).

    ``values`` maps new column names to the expressions carried.
    """
    keys = [*group, block]
    marked = df
    for name, expr in values.items():
        marked = marked.withColumn(f"_v_{name}", expr)
    local_frame = W.partitionBy(*keys).orderBy(*order)
    if backward:
        local_frame = local_frame.rowsBetween(0, W.unboundedFollowing)
        pick = F.first
    else:
        local_frame = local_frame.rowsBetween(W.unboundedPreceding, 0)
        pick = F.last
    local = marked
    for name in values:
        local = local.withColumn(
            f"_l_{name}", pick(f"_v_{name}", ignorenulls=True).over(local_frame)
        )
    # The value a block hands on is its last (first) non-null one.
    rank = F.struct(*order)
    edges = marked.groupBy(*keys).agg(
        *[
            (F.min_by if backward else F.max_by)(
                F.col(f"_v_{name}"), F.when(F.col(f"_v_{name}").isNotNull(), rank)
            ).alias(f"_e_{name}")
            for name in values
        ]
    )
    link = W.partitionBy(*group).orderBy(F.col(block).desc() if backward else F.col(block).asc())
    link = link.rowsBetween(W.unboundedPreceding, -1)
    handed = edges.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[
            F.last(f"_e_{name}", ignorenulls=True).over(link).alias(f"_h_{name}")
            for name in values
        ],
    )
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    out = local.join(handed, cond, "inner")
    for name in values:
        out = out.withColumn(name, F.coalesce(F.col(f"_l_{name}"), F.col(f"_h_{name}")))
    return out.drop(
        *[f"{p}{name}" for name in values for p in ("_v_", "_l_", "_h_")],
        *[f"_k_{k}" for k in keys],
    )


def neighbours(
    df: DataFrame,
    group: Sequence[str],
    block: str,
    order: Sequence[Column],
    value: Column,
    previous: str | None = "previous",
    following: str | None = "following",
) -> DataFrame:
    """Value of the row before and after, null at the ends of the group."""
    keys = [*group, block]
    marked = df.withColumn("_v", F.struct(value.alias("x")))
    local_frame = W.partitionBy(*keys).orderBy(*order)
    local = marked
    if previous:
        local = local.withColumn("_prev", F.lag("_v").over(local_frame))
    if following:
        local = local.withColumn("_next", F.lead("_v").over(local_frame))
    rank = F.struct(*order)
    edges = marked.groupBy(*keys).agg(
        F.min_by("_v", rank).alias("_first"), F.max_by("_v", rank).alias("_last")
    )
    link = W.partitionBy(*group).orderBy(F.col(block))
    handed = edges.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.lag("_last").over(link).alias("_from_before"),
        F.lead("_first").over(link).alias("_from_after"),
    )
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    out = local.join(handed, cond, "inner")
    if previous:
        out = out.withColumn(previous, F.coalesce("_prev", "_from_before")["x"])
    if following:
        out = out.withColumn(following, F.coalesce("_next", "_from_after")["x"])
    return out.drop(
        "_v", "_prev", "_next", "_from_before", "_from_after", *[f"_k_{k}" for k in keys]
    )
