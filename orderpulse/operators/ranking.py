"""Exact ranks, running sums and quantiles over groups of any size.

A plain window over a cutoff or a tenant would bring the whole group into one task. Here a table of distinct
values is cut into cells by an order-preserving function of the value: cell totals (a few thousand per group)
give every cell its starting offset, and only the rows of one cell meet in a window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.functions.exprs import null_safe_join
from orderpulse.session import cut_lineage

CELL_RESOLUTION = 1024


def value_cell(value: Column) -> Column:
    """Order-preserving bucket: log-spaced for large values, linear near zero; null stays null."""
    v = value.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * CELL_RESOLUTION).cast("long")


def _order(column: str, descending: bool) -> Column:
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()


def cumulate(
    table: DataFrame,
    by: Sequence[str],
    value: str,
    measures: Sequence[str],
    descending: bool = False,
    then: Sequence[str] = (),
) -> DataFrame:
    """Exclusive running sums (`<m>_before`) and group sums (`<m>_total`) in order of `value`, then `then`.

    `table` holds one row per (by, value, then); nulls in `value` come last.
    """
    by = list(by)
    cells_in = table.withColumn("_cell", value_cell(F.col(value)))
    group = by or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy(_order("_cell", descending)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*group)
    cells = cells_in.groupBy(*by, "_cell").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    cells = cells.select(
        *by,
        "_cell",
        *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_{m}_off") for m in measures],
        *[F.sum(f"_{m}").over(whole).alias(f"{m}_total") for m in measures],
    )
    joined = null_safe_join(cells_in, cells, [*by, "_cell"], "inner")
    inside = (
        Window.partitionBy(*by, "_cell")
        .orderBy(_order(value, descending), *[F.col(c).asc() for c in then])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for m in measures:
        joined = joined.withColumn(
            f"{m}_before", F.col(f"_{m}_off") + F.coalesce(F.sum(m).over(inside), F.lit(0))
        )
    return joined.drop("_cell", *[f"_{m}_off" for m in measures])


def pct_ranks(
    df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = (), copies: int = 1, digits: int | None = None,
) -> DataFrame:
    """Average rank of each column divided by the non-null count of its group (1 = largest).

    `columns` maps a column to the name of its rank. All columns are counted in one long table. `copies` says how
    many times every row will later be repeated, so that the rank equals the one that the repeated frame would
    give; `digits` decides ties after rounding, for values whose last bits depend on the order of a sum.
    """
    def tied(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.round(v, digits) if digits is not None else v

    long = df.select(
        *by,
        F.inline(F.array(*[F.struct(F.lit(c).alias("_measure"), tied(c).alias("_value")) for c in columns])),
    ).where("_value is not null")
    keys = [*by, "_measure"]
    counts = long.groupBy(*keys, "_value").agg((F.count(F.lit(1)) * copies).alias("_n"))
    ranked = cumulate(counts, keys, "_value", ["_n"]).select(
        *keys, "_value", ((F.expr("_n_before + (_n + 1) / 2")) / F.col("_n_total")).alias("_rank")
    )
    out = df
    for c, name in columns.items():
        one = ranked.where(F.col("_measure") == c).select(
            *by, F.col("_value").alias(f"_v_{name}"), F.col("_rank").alias(name)
        )
        out = null_safe_join(out.withColumn(f"_v_{name}", tied(c)), one, [*by, f"_v_{name}"], "left").drop(f"_v_{name}")
    return out


def pct_rank(
    df: DataFrame, value: str, by: Sequence[str] = (), name: str = "pct_rank", copies: int = 1,
    digits: int | None = None,
) -> DataFrame:
    return pct_ranks(df, {value: name}, by, copies, digits)


def rank_offsets(
    df: DataFrame, value: str, by: Sequence[str] = (), lead: Sequence[str] = (), descending: bool = True,
    running: Sequence[str] = (),
) -> DataFrame:
    """Rows (and running sums) that precede every (by, value, lead) combination, with the group totals."""
    counts = df.groupBy(*by, value, *lead).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_m_{c}") for c in running]
    )
    measures = ["_n", *[f"_m_{c}" for c in running]]
    offsets = cumulate(counts, by, value, measures, descending=descending, then=lead)
    return offsets.select(*by, value, *lead, *[f"{m}_{end}" for m in measures for end in ("before", "total")])


def apply_rank(
    df: DataFrame, offsets: DataFrame, value: str, by: Sequence[str] = (), ties: Sequence[str] = (), lead: Sequence[str] = (),
    name: str = "rank", total: str | None = None, running: Sequence[str] = (),
) -> DataFrame:
    joined = null_safe_join(df, offsets, [*by, value, *lead], "inner")
    local = Window.partitionBy(*by, value, *lead).orderBy(*[F.col(c) for c in ties] or [F.lit(0)])
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumns(
        {
            name: F.col("_n_before") + F.row_number().over(local),
            **({total: F.col("_n_total")} if total else {}),
            **{f"{c}_upto": F.col(f"_m_{c}_before") + F.sum(c).over(upto) for c in running},
            **{f"{c}_total": F.col(f"_m_{c}_total") for c in running},
        }
    )
    return out.drop("_n_before", "_n_total", *[f"_m_{c}_{end}" for c in running for end in ("before", "total")])


def exact_rank(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    name: str = "rank",
    total: str | None = None,
    descending: bool = True,
    spread: int = 2,
    running: Sequence[str] = (),
) -> DataFrame:
    """1-based row number by (value, ties) within `by`, nulls last; `total` names the group size.

    Rows that share a value are split further by the first `spread` tie columns. Every column in `running` also
    gets its inclusive running sum `<c>_upto` and its group sum `<c>_total`.
    """
    lead = [t for t in ties if t not in by][:spread]
    offsets = rank_offsets(df, value, by, lead, descending, running)
    return apply_rank(df, offsets, value, by, ties, lead, name, total, running)


def sorted_rank(
    df: DataFrame, value: str, by: Sequence[str], ties: Sequence[str], name: str = "rank", total: str | None = None,
    descending: bool = True,
) -> DataFrame:
    """The row number of `exact_rank` where many rows share a value and only a fine key parts them.

    The rows are dealt by sampled ranges of (by, value, ties), which are as even as the keys are distinct, and written
    once, so that counts and numbers see the same ranges; each range then starts from the rows of those before it.
    """
    order = [_order(value, descending), *[F.col(c).asc() for c in ties]]
    dealt = df.repartitionByRange(*[F.col(c).asc() for c in by], *order).withColumn("_range", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    counts = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    group = list(by) or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias("_all")
    )
    local = Window.partitionBy(*by, "_range").orderBy(*order)
    out = null_safe_join(dealt, counts, [*by, "_range"], "inner").withColumn(name, F.col("_before") + F.row_number().over(local))
    return (out.withColumn(total, F.col("_all")) if total else out).drop("_range", "_before", "_all")


def exact_ranks(
    df: DataFrame, specs: Sequence[tuple[str, Sequence[str], str]], ties: Sequence[str] = (), spread: int = 2,
    total: str | None = None,
) -> DataFrame:
    """Several descending ranks (value, by, name) of one frame; all offsets come from the frame as it is given, so
    the plan grows by one branch per rank instead of doubling."""
    out = df
    for i, (value, by, name) in enumerate(specs):
        lead = [t for t in ties if t not in by][:spread]
        offsets = rank_offsets(df, value, by, lead)
        out = apply_rank(out, offsets, value, by, ties, lead, name, total if i == 0 else None)
    return out


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], weight: str | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group; `weight` holds repeat counts if rows are counted.

    Cell totals locate the cells that hold the wanted positions; only the values of those cells are ordered.
    """
    by = list(by)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("_n"))
    counts = counts.withColumn("_cell", value_cell(F.col(value)))
    group = by or [F.lit(0)]
    cells = counts.groupBy(*by, "_cell").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *by, "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_total"), F.col("_n").alias("_cell_n"),
    )
    ends = [f"{f}((_total - 1) * {float(p)!r}D)" for p in probs.values() for f in ("floor", "ceil")]
    wanted = cells.where(" or ".join(f"(_off <= {e} and {e} < _off + _cell_n)" for e in ends)).drop("_cell_n")
    near = null_safe_join(counts, wanted, [*by, "_cell"], "inner")
    inside = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = near.withColumn("_before", F.col("_off") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    aggs = []
    for name, p in probs.items():
        pos = f"((_total - 1) * {float(p)!r}D)"
        for end, f in (("lo", "floor"), ("hi", "ceil")):
            hit = f"_before <= {f}{pos} and {f}{pos} < _before + _n"
            aggs.append(F.expr(f"max(if({hit}, cast(`{value}` as double), null)) as _{name}_{end}"))
        aggs.append(F.expr(f"max({pos} - floor{pos}) as _{name}_w"))
    return placed.groupBy(*by).agg(*aggs).selectExpr(
        *by, *[f"_{n}_lo + (_{n}_hi - _{n}_lo) * _{n}_w as {n}" for n in probs]
    )


def tercile(rank: Column, total: Column) -> Column:
    """low / mid / high by the equal-width edges of the rank range."""
    r3 = (rank - 1) * 3
    return (
        F.when(r3 < total - 1, F.lit("low")).when(r3 < (total - 1) * 2, F.lit("mid")).otherwise(F.lit("high"))
    )


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First n rows per group; Spark trims each map-side partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
