"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuemill.functions.durable import durable, shared_dir

__all__ = ["BLANKS", "GAP", "connected_components", "durable", "fresh", "let", "prefixes", "shared_dir", "spread_join", "words"]

#: What separates words, as a character list and as a regular expression.
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"

#: Keys with more than this share of all rows, and that many, are dealt over parts in :func:`spread_join`; there are at most 10,000.
_HOT, _MANY = 1e-4, 1000
_PARTS = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefixes(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """At each place of an array, its values up to there put together by an associative ``add``.

    Doubling steps: after the k-th, each place has what the 2^k places up to it hold, so
    an array of n values takes n log n steps.
    """
    def of(a: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            back = F.call_function("shiftleft", F.lit(1), k)
            return F.transform(acc, lambda x, i: F.when(i >= back, add(F.get(acc, i - back), x)).otherwise(x))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(a))).cast("int") - 1)
        return F.when(F.size(a) > 1, F.aggregate(steps, a, step)).otherwise(a)

    return let(values, of)


def words(text: Column) -> Column:
    """Array of the words of a text, empty for null."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it off the given columns (case aside)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(rows: DataFrame, found: DataFrame, on: str, part: Column, total: int, how: str = "inner", shuffled: bool = False) -> DataFrame:
    """``rows`` joined with ``found(on, n, …)``, one row per key, ``n`` being about the rows that hold it (dropped).

    Hashes of the keys of more than ``_HOT`` of the ``total`` rows, hence no more than
    ``1 / _HOT``, are broadcast; rows of such keys are dealt by ``part`` (a column that
    differs within a key) over ``_PARTS`` copies of the found row. So no key is one task.
    With ``shuffled`` the found rows are never broadcast, for which Spark may size them too low.
    Null keys match nothing; they are dealt too.
    """
    extra, spread, mark = fresh([*rows.columns, *found.columns], "hot_key", "spread", "is_hot")
    hot = F.broadcast(found.where(F.col("n") > max(total * _HOT, _MANY)).select(F.xxhash64(on).alias(extra), F.lit(True).alias(mark)).distinct())
    # both sides go by the hash, so that keys which share one are dealt alike
    left = rows.join(hot, F.xxhash64(rows[on]) == hot[extra], "left")
    deal = F.pmod(F.xxhash64(part), F.lit(_PARTS)).cast("int")
    left = left.withColumn(spread, F.when(F.col(mark) | F.col(on).isNull(), deal).otherwise(F.lit(0))).drop(extra, mark)
    right = found.join(hot, F.xxhash64(found[on]) == hot[extra], "left")
    parts = F.when(F.col(mark), F.sequence(F.lit(0), F.lit(_PARTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn(spread, F.explode(parts)).drop("n", extra, mark)
    return left.join(right.hint("merge") if shuffled else right, [on, spread], how).drop(spread)


def connected_components(edges: DataFrame, shuffled: bool = False) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a, b)``, as ``(node, component)``.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each is a
    minimum per node and a join, in which the edges of a node with many are dealt over
    tasks, so no component is ever gathered in one. Each round is written to the shared folder. Nodes without an edge to another node do
    not appear; null ends are ignored.
    """
    least, greatest = F.least("a", "b"), F.greatest("a", "b")
    now = durable(edges.where("a is not null and b is not null and a <> b").select(greatest.alias("hi"), least.alias("lo")).distinct(), "edges")
    seen, total = None, max(1, 2 * now.count())
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = durable(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "edges-low")
        large = spread_join(both, low, "u", F.col("v"), total, shuffled=shuffled).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = durable(large, "edges-large")
        root = durable(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n")), "edges-root")
        small = spread_join(large, root, "hi", F.col("lo"), total, shuffled=shuffled).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = durable(small.union(root.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = tuple(state)
