"""Cross-sectional scores as Column builders: within a window partition, usually one date."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_name(df: DataFrame) -> DataFrame:
    """df, a row a name and date, for a join by both: in sorted order, never broadcast. Dates and names repeat themselves, so
    such a table is small on disk, by which a plan would judge it, and large in memory."""
    return df.hint("merge")


def by(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def pct_rank(value: Column, *keys: str, ascending: bool = True) -> Column:
    """Rank with averaged ties over the count of non-null values, times 100; null stays null, all equal gives 50. Values
    that are equal but for rounding, to eight digits, are ties. The first and the last place of a tie come from one
    window: one sort a rank."""
    value = F.round(value, 8)
    places = by(*keys).orderBy(value.asc_nulls_last() if ascending else value.desc_nulls_last())
    rank = (F.rank().over(places) + F.count("*").over(places)) / 2
    even = F.min(value).over(by(*keys)) == F.max(value).over(by(*keys))
    return F.when(value.isNotNull(), F.when(even, 50.0).otherwise(F.try_divide(rank, F.count(value).over(by(*keys))) * 100))


def places(values: np.ndarray, ascending: bool) -> np.ndarray:
    """pct_rank of values without nulls. Values equal to eight digits are ties, as pct_rank rounds them: halves away from 0,
    and from 2 ** 26 on doubles lie too far apart to be rounded."""
    size = np.abs(values)
    with np.errstate(invalid="ignore"):
        values = np.where(size < 2.0**26, np.copysign(np.floor(size * 1e8 + 0.5) / 1e8, values), values)
    own, which, many = np.unique(values if ascending else -values, return_inverse=True, return_counts=True)
    if len(own) == 1:
        return np.full(len(values), 50.0)
    upto = np.cumsum(many)
    if not ascending and np.isnan(own[-1]):  # the greatest of all
        upto = np.append(upto[:-1] + many[-1], many[-1])
    return ((2 * upto - many + 1) / 2 / len(values) * 100)[which]


def _placed(x: pa.Array, ascending: bool) -> pa.Array:
    known, out = x.is_valid().to_numpy(zero_copy_only=False), np.zeros(len(x))
    if known.any():
        out[known] = places(x.drop_null().to_numpy(zero_copy_only=False), ascending)
    return pa.array(out, mask=~known)


def ranked(df: DataFrame, ranks: dict[str, tuple[Column, bool]], *keys: str) -> DataFrame:
    """Adds the pct_rank of each column, ascending or not, within keys. All ranks of a group are made together: rows move
    and are sorted once, by keys, and a rank holds no more than its own numbers, where windows hold a copy of all rows
    for each rank."""
    df = df.withColumns({n: value.cast("double") for n, (value, _) in ranks.items()})
    up = {n: ascending for n, (_, ascending) in ranks.items()}

    def run(group: pa.Table) -> pa.Table:
        for n, ascending in up.items():
            i = group.schema.get_field_index(n)
            group = group.set_column(i, group.schema.field(i), _placed(group.column(n).combine_chunks(), ascending))
        return group

    return df.groupBy(*keys).applyInArrow(run, df.schema)


def ranks_of(df: DataFrame, ranks: dict[str, tuple[str, bool]], keep: list[str], *keys: str) -> DataFrame:
    """keys, keep and the pct_rank of each named column, ascending or not, within keys. As ranked, but a column moves once
    however many ranks come from it, and those that aren't kept go with their ranks."""
    names = list(dict.fromkeys(c for c, _ in ranks.values()))
    df = df.select(*keys, *keep, *[F.col(c).cast("double").alias(f"__v_{c}") for c in names])

    def run(group: pa.Table) -> pa.Table:
        own = {c: group.column(f"__v_{c}").combine_chunks() for c in names}
        return pa.table({**{c: group.column(c) for c in (*keys, *keep)}, **{n: _placed(own[c], up) for n, (c, up) in ranks.items()}})

    schema = df.select(*keys, *keep, *[F.lit(None).cast("double").alias(n) for n in ranks]).schema
    return df.groupBy(*keys).applyInArrow(run, schema)


def zscore(value: Column, *keys: str) -> Column:
    """(x - mean) / population deviation; 0 where that is 0 or null."""
    sd = F.stddev_pop(value).over(by(*keys))
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((value - F.avg(value).over(by(*keys))) / sd)


def blend(weights: dict[str, float]) -> Column:
    """Weighted mean of the named columns over those that aren't null; null where no weight is left."""
    top = reduce(lambda a, b: a + b, (F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()))
    below = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items()))
    return F.when(below > 0, top / below)


def clipped(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def winsorize(df: DataFrame, column: str, keys: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Clips column to its interpolated quantiles within keys; groups of fewer than three values stay as they are."""
    q = df.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("__q"), F.count(column).alias("__n"))
    x = F.col(column)
    bounded = F.when(x.isNotNull(), F.when(F.col("__n") < 3, x).otherwise(F.greatest(F.element_at("__q", 1), F.least(F.element_at("__q", 2), x))))
    return df.join(q, keys).withColumn(column, bounded).drop("__q", "__n")


def sector_neutral(df: DataFrame, column: str, keys: list[str], sector: str = "sector") -> DataFrame:
    """Demeaned within sector, then ranked over keys; gaps that are equal but for rounding are ties."""
    gap = df.withColumn("__gap", F.round(F.col(column) - F.avg(column).over(by(*keys, sector)), 9))
    return gap.withColumn(column, pct_rank(F.col("__gap"), *keys)).drop("__gap")


def normalised(weight: Column, *keys: str) -> Column:
    """Negative weights count as 0; shares of the sum, equal shares where that is 0."""
    w = F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0))
    total = F.sum(w).over(by(*keys))
    return F.when(total > 0, w / total).otherwise(1.0 / F.count("*").over(by(*keys)))
