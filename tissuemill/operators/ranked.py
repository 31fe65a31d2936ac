"""Ranks, running totals and order statistics over whole tables, without a window that holds one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuemill.functions.durable import durable
from tissuemill.operators.reshape import c


def same_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    """Condition that the keys agree, nulls with nulls."""
    out = F.lit(True)
    for k in on:
        out = out & left[f"`{k}`"].eqNullSafe(right[f"`{k}`"])
    return out


def with_statistics(df: DataFrame, by: Sequence[str], statistics: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates of its groups as columns: grouped and joined back, so a large group is no single task's."""
    stats = df.groupBy(*[c(k) for k in by]).agg(*[a.alias(n) for n, a in statistics.items()])
    renamed = stats.select(*[c(k).alias(f"_by_{i}") for i, k in enumerate(by)], *[c(n) for n in statistics])
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & c(k).eqNullSafe(F.col(f"_by_{i}"))
    return df.join(renamed, on).drop(*[f"_by_{i}" for i in range(len(by))])


def running(df: DataFrame, order: Sequence[Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` with the sums of some columns up to and with each row, in an order over the whole table.

    Rows are cut into ranges of the order; each task adds up its own range, and what
    lies before it comes from one row per range.
    """
    ranged = df.withColumns({f"_sum_{n}": x for n, x in totals.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = durable(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranged")
    parts = ranged.groupBy("_range").agg(*[F.sum(f"_sum_{n}").alias(f"_all_{n}") for n in totals])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_range", *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals])
    upto = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(parts), "_range")
    return out.select(*[c(x) for x in df.columns], *[(c(f"_before_{n}") + F.sum(f"_sum_{n}").over(upto)).alias(n) for n in totals])


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "_row") -> DataFrame:
    """Column ``name``: 0-based place in the order."""
    out = running(df, [F.col(o) if isinstance(o, str) else o for o in order], {name: F.lit(1).cast("long")})
    return out.withColumn(name, c(name) - 1)


def values_at(df: DataFrame, group: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Per group, its values at 0-based ranks of their order; nulls count nowhere.

    ``ranks`` are columns of ``all``, the group's number of values; a rank outside it
    gives null. Values are counted first and cut into ranges; sums per range give the
    range of each rank, and only that one is gone through in order.
    """
    counted = df.where(c(value).isNotNull()).groupBy(*[c(k) for k in group], c(value)).agg(F.count(F.lit(1)).alias("_n"))
    order = [*[c(k) for k in group], c(value)]
    ranged = durable(counted.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "value-ranges")
    keys = [F.col(f"_by_{i}") for i in range(len(group))]
    named = ranged.select(*[c(k).alias(f"_by_{i}") for i, k in enumerate(group)], c(value).alias("_v"), "_n", "_range")
    parts = named.groupBy(*keys, "_range").agg(F.sum("_n").alias("_part"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_part").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumns({"_upto": upto, "all": F.sum("_part").over(w)})
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank")) for n, r in ranks.items()])
    hit = parts.withColumn("w", F.explode(wanted)).where((F.col("w.rank") >= F.col("_upto") - F.col("_part")) & (F.col("w.rank") < F.col("_upto")))
    hit = durable(hit.select(*keys, "_range", "w.name", "w.rank", (F.col("_upto") - F.col("_part")).alias("_before")), "value-ranks")
    near = named.withColumnsRenamed({f"_by_{i}": f"_of_{i}" for i in range(len(group))}).withColumnRenamed("_range", "_in")
    on = F.col("_in") == F.col("_range")
    for i in range(len(group)):
        on = on & F.col(f"_of_{i}").eqNullSafe(F.col(f"_by_{i}"))
    inside = near.join(hit, on)
    run = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "name", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_run", run).where(F.col("_run") > F.col("rank")).groupBy(*keys).agg(*[F.min(F.when(F.col("name") == n, F.col("_v"))).alias(f"_at_{i}") for i, n in enumerate(ranks)])
    return found.select(*[k.alias(g) for k, g in zip(keys, group)], *[F.col(f"_at_{i}").alias(n) for i, n in enumerate(ranks)])


#: Accuracy of the sketches that bracket a quantile; smaller groups are counted whole.
_ACCURACY = 10_000


def quantiles(df: DataFrame, group: Sequence[str], columns: Sequence[str], qs: Sequence[float], linear: bool | Sequence[bool] = True) -> DataFrame:
    """Exact quantiles of many columns per group, found together: ``(group…, column, n, values array<double>)``, a row per group and column with values.

    Two passes over the table, and no row of it is shuffled. The first sketches every column per group, which
    brackets each quantile between two values a few in ten thousand ranks apart; the
    second counts what lies below a bracket and, per different value, what lies inside. So a task gets
    six in ``_ACCURACY`` of a group's values to put in order, or all of a group of no more than that many.
    ``linear`` interpolates between two ranks (one flag for each of ``qs``, or for all); else it is the nearest rank's, half away from zero. Null groups count, null values do not.
    """
    lines = [linear] * len(qs) if isinstance(linear, bool) else list(linear)
    keys, margin = [f"_by_{i}" for i in range(len(group))], 3 / _ACCURACY
    rows = df.select(*[c(k).alias(b) for k, b in zip(group, keys)], *[c(x).cast("double").alias(f"_x_{i}") for i, x in enumerate(columns)])
    at = F.array(*[F.lit(float(min(1.0, max(0.0, q + s * margin)))) for q in qs for s in (-1, 1)])
    ends = rows.groupBy(*keys).agg(*[F.struct(F.count(f"_x_{i}").alias("n"), F.percentile_approx(F.nanvl(f"_x_{i}", F.lit(float("inf"))), at, F.lit(_ACCURACY)).alias("b")).alias(f"_e_{i}") for i in range(len(columns))])
    ends = durable(ends, "quantile-ends").withColumnsRenamed({k: f"{k}_" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
    joined = rows.join(ends, on) if keys else rows.crossJoin(F.broadcast(ends))

    def cells(i: int) -> list[Column]:
        x, e = F.col(f"_x_{i}"), F.col(f"_e_{i}")
        cell = lambda k, v, keep: F.when(keep, F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), e["n"].alias("all"), v.alias("v")))
        small = e["n"] <= _ACCURACY
        # an end of the order is open, and so is a bracket that ends with infinity, which stands for NaN in the sketch
        above = lambda k: F.lit(True) if qs[k] <= margin else x >= e["b"][2 * k]
        below = lambda k: F.lit(True) if qs[k] >= 1 - margin else (x <= e["b"][2 * k + 1]) | (e["b"][2 * k + 1] == float("inf"))
        bracketed = [cell(k, F.when(above(k), x), ~small & x.isNotNull() & below(k)) for k in range(len(qs))]
        return [cell(-1, x, small & x.isNotNull()), *bracketed]

    each = F.filter(F.array(*[x for i in range(len(columns)) for x in cells(i)]), lambda x: x.isNotNull())
    counted = joined.select(*keys, F.explode(each).alias("c")).groupBy(*keys, "c.i", "c.k", "c.all", "c.v").agg(F.count(F.lit(1)).alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(*keys, "i", "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("_bracket_run", run).where("v is not null")

    def value(k: int, q: float, line: bool) -> Column:
        place = (F.col("all") - 1) * F.lit(float(q))
        own = F.col("k").isin(-1, k)
        pick = lambda rank: F.min(F.when(own & (F.col("_bracket_run") > rank), F.col("v")))
        low, high = (F.floor(place), F.ceil(place)) if line else (F.round(place), F.round(place))
        found = pick(low) * (1 - (F.first(place) - F.first(low))) + pick(high) * (F.first(place) - F.first(low)) if line else pick(low)
        held = (F.min(F.when(own, F.col("_bracket_run") - F.col("_n"))) <= F.first(low)) & (F.max(F.when(own, F.col("_bracket_run"))) > F.first(high))
        return F.when(held, found).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")))

    out = counted.groupBy(*keys, "i", "all").agg(F.array(*[value(k, q, line) for k, (q, line) in enumerate(zip(qs, lines))]).alias("values"))
    name = F.get(F.array(*[F.lit(x) for x in columns]), F.col("i"))
    return out.select(*[F.col(b).alias(k) for b, k in zip(keys, group)], name.alias("column"), F.col("all").alias("n"), "values")


def quantiles_wide(df: DataFrame, group: Sequence[str], columns: Sequence[str], qs: dict[str, float], linear: bool | Sequence[bool] = True) -> DataFrame:
    """:func:`quantiles` with one row per group and a column ``{column}{suffix}`` for each suffix of ``qs``."""
    tall = quantiles(df, group, columns, list(qs.values()), linear)
    pick = [F.max(F.when(F.col("column") == x, F.get("values", F.lit(k)))).alias(f"{x}{suffix}") for x in columns for k, suffix in enumerate(qs)]
    return tall.groupBy(*[c(k) for k in group]).agg(*pick)


def lowest(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "_k", parts: int = 64) -> DataFrame:
    """The ``n`` first rows of each group in an order, numbered from 1: first those of each of its parts, then of all of them."""
    deal = F.pmod(F.xxhash64(*order), F.lit(parts))
    each = df.withColumn("_deal", deal)
    first = each.withColumn(name, F.row_number().over(Window.partitionBy(*[c(k) for k in by], "_deal").orderBy(*order))).where(c(name) <= n).drop("_deal", name)
    return first.withColumn(name, F.row_number().over(Window.partitionBy(*[c(k) for k in by]).orderBy(*order))).where(c(name) <= n)
