"""Exact order statistics that stay distributed.

A global median or rank in one task does not survive a large table.  Here the
values are first counted (``groupBy`` combines before its shuffle), the counts
are cut into slices of the value axis, and only per-slice totals are scanned in
order.  The slice number grows with the value and has a fixed range, so the
ordered scan sees a bounded number of rows however large the input is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES_PER_OCTAVE = 64


def value_slice(value: Column) -> Column:
    """Order-preserving slice number; at most 2 * 1024 * 64 different ones."""
    depth = F.floor(F.log2(F.lit(1.0) + F.abs(value)) * F.lit(float(SLICES_PER_OCTAVE)))
    return (F.signum(value) * depth).cast("long")


def _counted(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("__value"))
        .agg(F.count("*").alias("__n"))
        .withColumn("__slice", value_slice(F.col("__value")))
    )


def _slice_offsets(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows before each slice and in all, per group."""
    group = [F.col(c) for c in by] or [F.lit(0)]
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.groupBy(*by, "__slice")
        .agg(F.sum("__n").alias("__in"))
        .withColumns(
            {
                "__before": F.coalesce(F.sum("__in").over(before), F.lit(0)),
                "__total": F.sum("__in").over(whole),
            }
        )
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Interpolated quantiles of ``value`` per group, one column per entry of ``probs``."""
    counted = _counted(df, value, by)
    offsets = _slice_offsets(counted, by)
    last = F.col("__total") - 1
    wanted = []
    for name, p in probs.items():
        position = last * F.lit(float(p))
        for end, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            wanted.append(
                F.struct(
                    F.lit(name).alias("name"),
                    F.lit(end).alias("end"),
                    rank.cast("long").alias("rank"),
                    (position - F.floor(position)).alias("share"),
                )
            )
    in_slice = F.filter(
        F.array(*wanted),
        lambda w: (w["rank"] >= F.col("__before"))
        & (w["rank"] < F.col("__before") + F.col("__in")),
    )
    hits = offsets.select(
        *by, "__slice", "__before", F.explode(in_slice).alias("__w")
    ).select(
        *[F.col(c).alias(f"__h_{c}") for c in by],
        F.col("__slice").alias("__h_slice"),
        (F.col("__w.rank") - F.col("__before")).alias("__rank"),
        F.col("__w.name").alias("__name"),
        F.col("__w.end").alias("__end"),
        F.col("__w.share").alias("__share"),
    )
    within = (
        Window.partitionBy(*by, "__slice")
        .orderBy("__value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    on = F.col("__slice") == F.col("__h_slice")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__h_{c}"))
    slices = hits.select("__h_slice", *[f"__h_{c}" for c in by]).distinct()
    upto = counted.join(slices, on, "left_semi").withColumn(
        "__upto", F.sum("__n").over(within)
    )
    picked = upto.join(
        hits,
        on
        & (F.col("__rank") < F.col("__upto"))
        & (F.col("__rank") >= F.col("__upto") - F.col("__n")),
    )

    def value_at(name: str, end: str) -> Column:
        mine = (F.col("__name") == name) & (F.col("__end") == end)
        return F.max(F.when(mine, F.col("__value")))

    def quantile(name: str) -> Column:
        low, high = value_at(name, "lo"), value_at(name, "hi")
        share = F.max(F.when(F.col("__name") == name, F.col("__share")))
        return (low + (high - low) * share).alias(name)

    return picked.groupBy(*by).agg(*[quantile(name) for name in probs])


def _average_ranks(
    pairs: DataFrame, column: str, out: str, by: Sequence[str]
) -> DataFrame:
    """Average rank of every distinct value of ``column`` within its group."""
    counted = (
        pairs.groupBy(*by, F.col(column).alias("__value"))
        .agg(F.sum("n").alias("__n"))
        .withColumn("__slice", value_slice(F.col("__value")))
    )
    offsets = _slice_offsets(counted, by).select(*by, "__slice", "__before")
    within = (
        Window.partitionBy(*by, "__slice")
        .orderBy("__value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.withColumn("__upto", F.sum("__n").over(within))
    rank = F.col("__before") + F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)
    return ranked.join(offsets, [*by, "__slice"]).select(
        *by, F.col("__value").alias(column), rank.alias(out)
    )


def spearman(
    df: DataFrame, x: str, y: str, by: Sequence[str] = (), at_least: int = 3
) -> DataFrame:
    """``spearman`` per group: rank correlation with average ranks for ties.

    Pairs are counted first, so a common pair of values is one row in the joins.
    NULL for fewer than ``at_least`` complete pairs or without any variation.
    """
    by = list(by)
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y"))
        .agg(F.count("*").alias("n"))
    )
    ranked = pairs.join(_average_ranks(pairs, "x", "rx", by), [*by, "x"]).join(
        _average_ranks(pairs, "y", "ry", by), [*by, "y"]
    )
    n, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy(*by).agg(
        F.sum("n").alias("total"),
        F.sum(n * rx).alias("sx"),
        F.sum(n * ry).alias("sy"),
        F.sum(n * rx * rx).alias("sxx"),
        F.sum(n * ry * ry).alias("syy"),
        F.sum(n * rx * ry).alias("sxy"),
    )
    t = F.col("total")
    covariance = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), t)
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), t)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), t)
    rho = F.try_divide(covariance, F.sqrt(F.greatest(vx * vy, F.lit(0.0))))
    return sums.select(*by, F.when(t >= at_least, rho).alias("spearman"))


def pearson(x: Column, y: Column, at_least: int = 3) -> Column:
    """Aggregate: correlation of complete pairs; NULL when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    cx, cy = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(cx, cy), F.stddev_pop(cx) * F.stddev_pop(cy))
    return F.when(F.count(F.when(both, 1)) >= at_least, r)
