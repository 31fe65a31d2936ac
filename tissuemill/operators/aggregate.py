"""Aggregation along a hierarchy, statistics per group, bins, boxes."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuemill.operators.reshape import c, to_wide

Aggregate = Callable[[Sequence[str]], list[Column]]


def _each(suffix: str, f: Callable[[Column], Column]) -> Aggregate:
    return lambda names: [f(c(n)).alias(f"{n}__{suffix}") for n in names]


def quantile_nearest(column: Column, q: float) -> Column:
    """Value at ``round((n - 1) q)`` of the sorted non-null values, half away from zero; null without values.

    Collects a group's values; for groups too large for that see :func:`quantile_nearest_rows`.
    """
    values = F.array_sort(F.collect_list(column))
    return F.get(values, F.round((F.size(values) - 1) * F.lit(q)).cast("int"))


def quantile_nearest_rows(df: DataFrame, group: Sequence[str], column: str, qs: Sequence[float]) -> DataFrame:
    """The same quantiles per group without collecting or sorting one whole (:func:`ranked.quantiles`)."""
    from tissuemill.operators.ranked import quantiles

    kind = df.schema[column].dataType
    found = quantiles(df, group, [column], qs, linear=False)
    return found.select(*[c(k) for k in group], *[F.get("values", F.lit(k)).cast(kind).alias(f"{column}__Q({q})") for k, q in enumerate(qs)])


Count: Aggregate = lambda names: [F.count(F.lit(1)).alias("Count")]
Mean = _each("Mean", F.avg)
Sum = _each("Sum", lambda x: F.coalesce(F.sum(x), F.lit(0)))
Min = _each("Min", lambda x: F.min(F.when(~F.isnan(x.cast("double")), x)))
Max = _each("Max", lambda x: F.max(F.when(~F.isnan(x.cast("double")), x)))
Median = _each("Median", lambda x: F.percentile(x, F.lit(0.5)))


def Quantile(q: float) -> Aggregate:  # noqa: N802
    return _each(f"Q({q})", lambda x: quantile_nearest(x, q))


def many_to_one(children: DataFrame, hierarchy: DataFrame, features: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """Child features per parent and child type.

    ``children(o, label, features…)``; ``hierarchy(o_child, label_child, o_parent,
    label_parent)``. Background parents, label 0, are left out.
    """
    h = hierarchy.where("label_parent <> 0")
    joined = h.join(children, (h["o_child"] == children["o"]) & (h["label_child"] == children["label"]))
    return joined.groupBy("o_parent", "label_parent", "o_child").agg(*[x for a in aggregates for x in a(features)])


def many_to_one_quantiles(children: DataFrame, hierarchy: DataFrame, features: Sequence[str], qs: dict[str, float], linear: bool = True) -> DataFrame:
    """Quantiles of all features per parent and child type in one pair of passes (:func:`ranked.quantiles`), whatever the number of children: ``{feature}__{name}`` for each name of ``qs``."""
    from tissuemill.operators.ranked import quantiles_wide

    h = hierarchy.where("label_parent <> 0")
    joined = h.join(children, (h["o_child"] == children["o"]) & (h["label_child"] == children["label"])).select("o_parent", "label_parent", "o_child", *[c(f) for f in features])
    return quantiles_wide(joined, ["o_parent", "label_parent", "o_child"], features, {f"__{n}": q for n, q in qs.items()}, linear)


def many_to_one_wide(children: DataFrame, hierarchy: DataFrame, features: Sequence[str], aggregates: Sequence[Aggregate], types: Sequence[str] | None = None) -> DataFrame:
    """:func:`many_to_one` with one column per child type and aggregate, joined by ``__``."""
    return to_wide(many_to_one(children, hierarchy, features, aggregates), ["o_parent", "label_parent"], ["o_child"], sep="__", values=types)


def one_to_one(children: DataFrame, hierarchy: DataFrame, features: Sequence[str]) -> DataFrame:
    """Child features copied to the parent's key."""
    h = hierarchy.where("label_parent <> 0")
    joined = h.join(children, (h["o_child"] == children["o"]) & (h["label_child"] == children["label"]))
    return joined.select("o_parent", "label_parent", "o_child", *[c(f) for f in features])


def with_self(hierarchy: DataFrame, children_too: bool = False) -> DataFrame:
    """The hierarchy with every parent, or every object, as a child of itself."""
    own = hierarchy.select(F.col("o_parent").alias("o_child"), F.col("label_parent").alias("label_child"), "o_parent", "label_parent")
    if children_too:
        own = own.union(hierarchy.select("o_child", "label_child", F.col("o_child").alias("o_parent"), F.col("label_child").alias("label_parent")))
    return hierarchy.select("o_child", "label_child", "o_parent", "label_parent").union(own).dropDuplicates()


def cardinality(hierarchy: DataFrame) -> DataFrame:
    """``(o_child, o_parent, cardinality)`` of each pair of types: whether a child has several parents, a parent several children; background apart."""
    h = hierarchy.where("label_parent <> 0")
    per_parent = h.groupBy("o_child", "o_parent", "label_parent").agg(F.count(F.lit(1)).alias("n")).groupBy("o_child", "o_parent").agg(F.max("n").alias("children"))
    per_child = h.groupBy("o_child", "o_parent", "label_child").agg(F.count(F.lit(1)).alias("n")).groupBy("o_child", "o_parent").agg(F.max("n").alias("parents"))
    mark = lambda x: F.when(F.col(x) > 1, F.lit("m")).otherwise(F.lit("1"))
    return per_parent.join(per_child, ["o_child", "o_parent"]).select("o_child", "o_parent", F.concat_ws(":", mark("children"), mark("parents")).alias("cardinality"))


def type_lists(objects: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """``(o, level, parents, cardinality, place)`` per type of ``objects(o, level, parents array)``: its parent types with the cardinality of each pair (:func:`cardinality`), in the given order.

    Null parents, and cardinalities of pairs without rows, are left out. ``place`` numbers types from 0
    by level, the number of parents (most first) and name. Types are few: one row each.
    """
    given = objects.select("o", "level", F.posexplode_outer("parents").alias("_at", "parent"))
    pairs = cardinality(hierarchy).withColumnsRenamed({"o_child": "o", "o_parent": "parent"})
    rows = given.join(F.broadcast(pairs), ["o", "parent"], "left")
    entry = F.array_sort(F.collect_list(F.when(F.col("parent").isNotNull(), F.struct("_at", "parent", "cardinality"))))
    lists = rows.groupBy("o").agg(F.first("level").alias("level"), entry.alias("e"))
    lists = lists.select("o", "level", F.transform("e", lambda x: x["parent"]).alias("parents"), F.filter(F.transform("e", lambda x: x["cardinality"]), lambda x: x.isNotNull()).alias("cardinality"))
    return lists.withColumn("place", F.row_number().over(Window.orderBy("level", F.desc(F.size("parents")), "o")) - 1)


def hierarchy_features(objects: DataFrame, parent: Sequence[str], features: Sequence[str], types: Sequence[str], function: Callable[[Column], Column] = F.avg, name: str = "Mean") -> DataFrame:
    """Features of each type's objects per parent as ``{type}_{name}.{feature}``, in one aggregate; types a parent lacks are null."""
    return objects.groupBy(*[c(k) for k in parent]).agg(*[function(F.when(F.col("object") == t, c(f))).alias(f"{t}_{name}.{f}") for t in types for f in features])


def hierarchy_counts(objects: DataFrame, parent: Sequence[str], types: Sequence[str]) -> DataFrame:
    """Objects of each type per parent as ``{type}_Count``; types a parent lacks are null."""
    return objects.groupBy(*parent).agg(*[F.nullif(F.count(F.when(F.col("object") == t, 1)), F.lit(0)).alias(f"{t}_Count") for t in types])


def aggregate_hierarchy(children: DataFrame, hierarchy: DataFrame, features: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """Driver of the above: types with one child per parent are copied (joined by ``_``), others aggregated (``__``), all joined on the parent's key."""
    kinds = {(r["o_child"], r["o_parent"]): r["cardinality"] for r in cardinality(hierarchy).collect()}
    single, several = sorted({k[0] for k, v in kinds.items() if v.startswith("1")}), sorted({k[0] for k, v in kinds.items() if v.startswith("m")})
    parts = []
    if several:
        parts.append(many_to_one_wide(children, hierarchy.where(F.col("o_child").isin(several)), features, aggregates, several))
    if single:
        parts.append(to_wide(one_to_one(children, hierarchy.where(F.col("o_child").isin(single)), features), ["o_parent", "label_parent"], ["o_child"], values=single))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["o_parent", "label_parent"], "full")
    return out


def roi_metadata(nuclei: DataFrame, control_wells: Sequence[str]) -> DataFrame:
    """Per roi and parent 1: nuclei count, its log2 and rounded log2 (cycle), well, site, row and column of the roi's name, control well and its position (1000 if none), running embryo name.

    ``nuclei(roi, parent)``; roi names look like ``A01_px+0000_py+0000``. Parents 0 and null go, and so do all but parent 1.
    """
    counts = nuclei.where("parent = 1").groupBy("roi", "parent").agg(F.count(F.lit(1)).alias("count"))
    well = F.get(F.split("roi", "_"), F.lit(0))
    position = F.coalesce(*[F.when(F.col("well") == w, F.lit(i)) for i, w in enumerate(control_wells)], F.lit(1000))
    out = counts.withColumns({"log2": F.log2("count"), "cycle": F.round(F.log2("count")).cast("int"), "well": well,
                              "site": F.array_join(F.slice(F.split("roi", "_"), 2, 100), "_")})
    out = out.withColumns({"row": F.substring("well", 1, 1), "col": F.substring("well", 2, 10), "is_control_well": F.col("well").isin(list(control_wells)), "control_position": position})
    from tissuemill.operators.ranked import numbered

    return numbered(out, ["roi"], "_place").withColumn("embryo", F.concat(F.lit("emb_"), "_place")).drop("_place")


def cut(column: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed bins between the edges, open at both ends."""
    out = F.lit(labels[-1])
    for e, name in reversed(list(zip(edges, labels))):
        out = F.when(column <= e, F.lit(name)).otherwise(out)
    return F.when(column.isNotNull(), out)


def pooled_cycle(column: Column) -> Column:
    """Cycle bins that end at 9.5, 10.5 and 11.5."""
    return cut(column, (9.5, 10.5, 11.5), (9, 10, 11, 12))


def null_counts(df: DataFrame, zero: bool = True) -> DataFrame:
    """``(column, nulls, share)``: null or NaN values of each column, most first."""
    is_null = {f.name: c(f.name).isNull() | (F.isnan(c(f.name)) if f.dataType.simpleString() in ("double", "float") else F.lit(False)) for f in df.schema.fields}
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(x).alias(n) for n, x in is_null.items()])
    tall = one.unpivot("_n", [c(n) for n in df.columns], "column", "nulls").select("column", "nulls", (F.col("nulls") / F.col("_n")).alias("share"))
    return (tall if zero else tall.where("nulls > 0")).orderBy(F.desc("nulls"), "column")


def null_share(df: DataFrame) -> Column:
    """Nulls over non-nulls of the whole table, as an aggregate column."""
    nulls = sum((F.count_if(c(n).isNull()) for n in df.columns), F.lit(0))
    return nulls / sum((F.count(c(n)) for n in df.columns), F.lit(0))


def circular(column: Column) -> dict[str, Column]:
    """Circular mean in [0, 2π), resultant length, variance and deviation as aggregates."""
    s, k, n = F.sum(F.sin(column)), F.sum(F.cos(column)), F.count(column)
    r = F.least(F.hypot(s, k) / n, F.lit(1.0))
    return {"circmean": F.pmod(F.atan2(s, k), F.lit(2 * math.pi)), "circr": r, "circvar": 1 - r, "circstd": F.sqrt(-2 * F.ln(r))}


def medians(df: DataFrame, group: Sequence[str], column: str, name: str = "median") -> DataFrame:
    """Medians per group (:func:`ranked.quantiles`), for large groups."""
    from tissuemill.operators.ranked import quantiles

    return quantiles(df, group, [column], [0.5]).select(*[c(k) for k in group], F.get("values", F.lit(0)).alias(name))


def error_bars(df: DataFrame, group: Sequence[str], column: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Mean, median and nearest quantiles of a column per group, null groups too."""
    from tissuemill.operators.ranked import quantiles

    q = quantiles(df, group, [column], [0.5, low, high], [True, False, False])
    q = q.select(*[c(k).alias(f"_key_{i}") for i, k in enumerate(group)], *[F.get("values", F.lit(i)).alias(n) for i, n in enumerate(("median", "low", "high"))])
    on = F.lit(True)
    for i, k in enumerate(group):
        on = on & c(k).eqNullSafe(F.col(f"_key_{i}"))
    return df.groupBy(*[c(k) for k in group]).agg(F.avg(c(column)).alias("mean")).join(q, on, "left").select(*[c(k) for k in group], "mean", "median", "low", "high")


def score_table(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Numeric columns' medians and other columns' first values (smallest) per group."""
    rest = [f for f in df.schema.fields if f.name not in group]
    pick = lambda f: F.percentile(c(f.name), F.lit(0.5)) if f.dataType.typeName() in ("double", "float", "integer", "long", "short") else F.min(c(f.name))
    return df.groupBy(*group).agg(*[pick(f).alias(f.name) for f in rest])


def bounding_box(axes: Sequence[str] = ("z", "y", "x")) -> list[Column]:
    """Aggregates that unite boxes ``{axis}_lower``, ``{axis}_upper``."""
    return [f(f"{a}_{e}").alias(f"{a}_{e}") for a in axes for e, f in (("lower", F.min), ("upper", F.max))]


def box_lists(df: DataFrame, group: Sequence[str], key: str, axes: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Per group a list ``boxes`` of ``(key, (lower, upper) per axis)``, in the keys' order."""
    box = F.struct(c(key).alias(key), *[F.struct(F.col(f"{a}_lower").alias("lower"), F.col(f"{a}_upper").alias("upper")).alias(a) for a in axes])
    return df.groupBy(*group).agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def quantile_extents(df: DataFrame, group: Sequence[str], q: float, axes: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Quantile of the box extent per axis and group: the nearest rank's (:func:`quantile_nearest_rows`), rounded up; no group is held whole."""
    sizes = df.withColumns({f"_{a}": F.col(f"{a}_upper") - F.col(f"{a}_lower") for a in axes})
    parts = [quantile_nearest_rows(sizes.select(*group, f"_{a}"), group, f"_{a}", [q]) for a in axes]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(group), "full")
    return out.select(*group, *[F.ceil(c(f"_{a}__Q({q})")).cast("int").alias(a) for a in axes])


def extents(df: DataFrame, group: Sequence[str], axes: Sequence[str] = ("z", "y", "x"), padding: int = 0) -> DataFrame:
    """Largest box extent per axis and group, padded and rounded up to even, x and y alike."""
    out = df.groupBy(*group).agg(*[F.max(F.col(f"{a}_upper") - F.col(f"{a}_lower")).alias(a) for a in axes])
    even = lambda x: (F.ceil((x + 2 * padding) / 2) * 2).cast("int")
    out = out.withColumns({a: even(F.col(a)) for a in axes})
    return out.withColumns({"x": F.greatest("x", "y"), "y": F.greatest("x", "y")}) if {"x", "y"} <= set(axes) else out


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns as ``(a, b, r)``, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(c(a), c(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def bins_2d(df: DataFrame, x: Column, y: Column, dx: float, dy: float, value: Column | None = None, by: Column | None = None, log_x: bool = False, log_y: bool = False) -> DataFrame:
    """Counts, and the mean of ``value``, on a grid of ``dx`` by ``dy``, per category ``by`` if given; steps of a logarithmic axis are in powers of ten, and values of 0 or less are in no bin."""
    x, y = F.log10(x) if log_x else x, F.log10(y) if log_y else y
    df = df.where(x.isNotNull() & y.isNotNull()) if log_x or log_y else df
    keys = [F.floor(x / dx).alias("bx"), F.floor(y / dy).alias("by")] + ([by.alias("category")] if by is not None else [])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *([F.avg(value).alias("mean")] if value is not None else []))


def cell_counts(df: DataFrame, prefix: str) -> DataFrame:
    """Objects per file prefix: ``cell_count``, its log2 and rounded log2 (``cycle``), the ``well`` (first part of the prefix) and ``embryo`` (third last and last part)."""
    parts = F.split(c(prefix), "_")
    third = F.when(F.size(parts) >= 3, F.element_at(parts, -3))
    out = df.groupBy(c(prefix)).agg(F.count(F.lit(1)).alias("cell_count"))
    return out.withColumns({"log2_cell_count": F.log2("cell_count"), "cycle": F.round(F.log2("cell_count")).cast("int"), "well": F.get(parts, F.lit(0)), "embryo": F.concat_ws("_", third, F.element_at(parts, -1))})


def dataset_extents(sites: DataFrame, axes: Sequence[str] = ("z", "y", "x"), names: Sequence[str] = ()) -> DataFrame:
    """One row for all sites: per axis the least lower and greatest upper end and the largest size, and the sorted union of each list column."""
    ends = [x for a in axes for x in (F.min(f"{a}_lower").alias(f"{a}_min"), F.max(f"{a}_upper").alias(f"{a}_max"), F.max(F.col(f"{a}_upper") - F.col(f"{a}_lower")).alias(f"{a}_size"))]
    out = sites.agg(*ends)
    for n in names:
        each = sites.select(F.explode(n).alias(n)).distinct().agg(F.array_sort(F.collect_list(n)).alias(n))
        out = out.crossJoin(F.broadcast(each))
    return out
