"""Window operators, samples, order, set operations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuemill.operators import ranked
from tissuemill.operators.reshape import c


def z_scored(df: DataFrame, value: str, by: Sequence[str], name: str = "z") -> DataFrame:
    """Column ``name``: distance from the group's mean in sample standard deviations; groups' statistics are joined."""
    out = ranked.with_statistics(df, by, {"_mean": F.avg(c(value)), "_sd": F.stddev_samp(c(value))})
    return out.withColumn(name, (c(value) - F.col("_mean")) / F.col("_sd")).drop("_mean", "_sd")


def mean_normalised(df: DataFrame, value: str, by: Sequence[str], name: str = "m") -> DataFrame:
    """Column ``name``: value over the group's mean."""
    return ranked.with_statistics(df, by, {"_mean": F.avg(c(value))}).withColumn(name, c(value) / F.col("_mean")).drop("_mean")


def random_order(keys: Sequence[str], seed: int) -> Column:
    """A pseudo-random order that depends on the keys and the seed alone: an MD5 of both."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c(k).cast("string"), F.lit("")) for k in keys]))


def stratified_sample(df: DataFrame, by: Sequence[str], n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``n`` rows per stratum in :func:`random_order`."""
    return ranked.lowest(df, by, [random_order(keys, seed), *[c(k) for k in keys]], n).drop("_k")


def _stratum_samples(df: DataFrame, stratum: str, n: int, keys: Sequence[str], seed: int, must_keep: Column | None) -> DataFrame:
    """``n`` rows per stratum in :func:`random_order`, with ``_k`` from 1 and the stratum's number ``_n``; rows that must be kept come before all others and are then mixed with them."""
    order = [random_order(keys, seed), *[c(k) for k in keys]]
    if must_keep is None:
        rows = ranked.lowest(df, [stratum], order, n)
    else:
        first = F.when(F.coalesce(must_keep, F.lit(False)), F.lit(0)).otherwise(F.lit(1))
        rows = ranked.lowest(df, [stratum], [first, *order], n).drop("_k")
        # what is left of a stratum has no more than n rows
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(c(stratum)).orderBy(*order)))
    return ranked.with_statistics(rows, [stratum], {"_n": F.count(F.lit(1))})


def _neighbours(df: DataFrame, stratum: str) -> DataFrame:
    """Each stratum with the next and the last one; one row per stratum."""
    w = Window.orderBy(stratum)
    return df.select(stratum).distinct().withColumns({"_next": F.lead(stratum).over(w), "_last": F.lag(stratum).over(w)})


def sliding_samples(df: DataFrame, stratum: str, n: int, overlap: int, keys: Sequence[str], seed: int = 42, must_keep: Column | None = None) -> DataFrame:
    """Samples per stratum named by it, and blocks ``a-b`` of the last rows of one and the first of the next; column ``window``.

    Rows for which ``must_keep`` is true (annotated ones, say) are in their stratum's sample whatever their order, up to ``n``.
    """
    rows = _stratum_samples(df, stratum, n, keys, seed, must_keep).join(_neighbours(df, stratum), stratum)
    name = lambda a, b: F.concat_ws("-", F.col(a).cast("string"), F.col(b).cast("string"))
    own = rows.withColumn("window", F.col(stratum).cast("string"))
    tail = rows.where((F.col("_k") > F.col("_n") - overlap) & F.col("_next").isNotNull()).withColumn("window", name(stratum, "_next"))
    head = rows.where((F.col("_k") <= overlap) & F.col("_last").isNotNull()).withColumn("window", name("_last", stratum))
    return own.union(tail).union(head).drop("_k", "_n", "_next", "_last")


def sliding_relations(df: DataFrame, stratum: str, n: int, overlap: int, keys: Sequence[str], seed: int = 42, must_keep: Column | None = None) -> DataFrame:
    """For each row that two windows of :func:`sliding_samples` share, ``(keys, window, place, next_window, next_place)``: its 0-based places in both."""
    rows = _stratum_samples(df, stratum, n, keys, seed, must_keep)
    sizes = rows.select(F.col(stratum).alias("_of"), "_n").distinct().withColumnRenamed("_n", "_m")
    around = _neighbours(df, stratum).join(sizes, F.col("_last") == F.col("_of"), "left").drop("_of")
    rows = rows.join(around, stratum)
    text = lambda a: F.col(a).cast("string")
    place = F.col("_k") - 1
    begin = F.greatest(F.col("_n") - overlap, F.lit(0))
    tail = F.when((F.col("_k") > F.col("_n") - overlap) & F.col("_next").isNotNull(), F.struct(text(stratum).alias("window"), place.alias("place"), F.concat_ws("-", text(stratum), text("_next")).alias("next_window"), (place - begin).alias("next_place")))
    head = F.when((F.col("_k") <= overlap) & F.col("_last").isNotNull(), F.struct(F.concat_ws("-", text("_last"), text(stratum)).alias("window"), (F.least("_m", F.lit(overlap)) + place).alias("place"), text(stratum).alias("next_window"), place.alias("next_place")))
    return rows.select(*[c(k) for k in keys], F.explode(F.filter(F.array(tail, head), lambda x: x.isNotNull())).alias("r")).select(*[c(k) for k in keys], "r.*")


def subset(df: DataFrame, condition: str = "cycle between 8 and 12") -> DataFrame:
    """Rows that meet a condition."""
    return df.where(condition)


def sorted_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by several keys, each ascending or, with ``-`` before it, descending; ``#`` before a list's name means its length."""
    order = []
    for k in keys:
        down, name = k.startswith("-"), k.lstrip("-")
        x = F.size(c(name[1:])) if name.startswith("#") else c(name)
        order.append(x.desc() if down else x.asc())
    return df.orderBy(*order)


def track_time(df: DataFrame, track: str, time: str) -> DataFrame:
    """``t`` from the track's start and ``phase`` in [0, 2π]."""
    w = Window.partitionBy(track)
    t = df.withColumn("t", F.col(time) - F.min(time).over(w))
    return t.withColumn("phase", 2 * math.pi * F.col("t") / F.max("t").over(w))


def rank0(by: Sequence[str], order: Sequence[Column]) -> Column:
    """0-based place in the order within a group."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1


def path_length(mask: Column, spacing: float, line: Sequence[str], axis: str) -> Column:
    """Running length of the mask along an axis."""
    return F.sum(mask * F.lit(spacing)).over(Window.partitionBy(*line).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0))


def best(df: DataFrame, score: Column, n: int, ties: Sequence[str]) -> DataFrame:
    """The ``n`` rows with the highest score."""
    return df.orderBy(score.desc(), *ties).limit(n)


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows in :func:`random_order`: a top-n per task, then of those."""
    return df.orderBy(random_order(keys, seed), *keys).limit(n)


def every_nth(df: DataFrame, n: int, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every n-th row of each group, the first included."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).where(F.col("_k") % n == 0).drop("_k")
