"""Per-object features of voxel tables ``(roi, z, y, x, label)`` and ``(roi, z, y, x, value)``."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tissuemill.functions.durable import durable
from tissuemill.operators.lines import perimeter as perimeter  # faces are counted on runs

AXES = ("z", "y", "x")
OBJECT = ("roi", "label")


def _exact_moment(a: str, b: str, scale: dict[str, float]) -> Column:
    """Second central moment of voxel places along two axes, from sums of integers: the only rounding is that of the last division."""
    whole = lambda x: F.sum(x).cast("decimal(19,0)")
    a_, b_ = F.col(a).cast("long"), F.col(b).cast("long")
    n = F.count(F.lit(1))
    apart = n.cast("decimal(19,0)") * whole(a_ * b_) - whole(a_) * whole(b_)
    return apart.cast("double") / (n * n).cast("double") * F.lit(float(scale[a] * scale[b]))


def label_features(voxels: DataFrame, scale: Sequence[float] = (1.0, 1.0, 1.0), shape: Sequence[int] | None = None) -> DataFrame:
    """Pixel count, size, centroid, box, border pixels, sphere radius and perimeter, second moments per object; label 0 left out.

    Border pixels lie on the image's edge (``shape``, else the roi's own extent).
    """
    v = voxels.where("label <> 0")
    if shape is None:
        ends = voxels.groupBy("roi").agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
        v = v.join(ends, "roi")
    else:
        v = v.withColumns({f"{n}_{a}": F.lit(e) for a, s in zip(AXES, shape) for n, e in (("lo", 0), ("hi", s - 1))})
    edge = F.lit(False)
    for a in AXES:
        edge = edge | (F.col(a) == F.col(f"lo_{a}")) | (F.col(a) == F.col(f"hi_{a}"))
    p = {a: F.col(a) * F.lit(float(s)) for a, s in zip(AXES, scale)}
    n = F.count(F.lit(1))
    unit = float(np.prod(scale))
    moments = [_exact_moment(a, b, dict(zip(AXES, scale))).alias(f"m_{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]]
    out = v.groupBy(*OBJECT).agg(
        n.alias("NumberOfPixels"), (n * unit).alias("PhysicalSize"), F.count_if(edge).alias("NumberOfPixelsOnBorder"),
        *[F.avg(p[a]).alias(f"Centroid-{a}") for a in AXES], *[f(a).alias(f"BoundingBox-{a}-{e}") for a in AXES for e, f in (("lower", F.min), ("upper", F.max))], *moments)
    radius = F.cbrt(3 * F.col("PhysicalSize") / (4 * math.pi))
    return out.withColumn("EquivalentSphericalRadius", radius).withColumn("EquivalentSphericalPerimeter", 4 * math.pi * F.pow("EquivalentSphericalRadius", F.lit(2.0)))


_PRINCIPAL = T.StructType([T.StructField(n, T.DoubleType()) for n in ("l1", "l2", "l3", *[f"a{i}{a}" for i in (1, 2, 3) for a in AXES])])


@F.pandas_udf(_PRINCIPAL)
def _principal(zz: pd.Series, zy: pd.Series, zx: pd.Series, yy: pd.Series, yx: pd.Series, xx: pd.Series) -> pd.DataFrame:
    """Eigenvalues, smallest first, and vectors with the largest component positive, of 3x3 covariances."""
    m = np.stack([np.stack([zz, zy, zx], -1), np.stack([zy, yy, yx], -1), np.stack([zx, yx, xx], -1)], -2)
    values, vectors = np.linalg.eigh(np.nan_to_num(m))
    at = np.abs(vectors).argmax(axis=1)
    vectors = vectors * np.where(np.take_along_axis(vectors, at[:, None, :], 1) < 0, -1.0, 1.0)
    cols = [values[:, i] for i in range(3)] + [vectors[:, j, i] for i in range(3) for j in range(3)]
    return pd.DataFrame(dict(zip(_PRINCIPAL.names, cols)))


def with_principal(features: DataFrame) -> DataFrame:
    """Principal moments and axes, Flatness, Elongation and ellipsoid diameters beside :func:`label_features`; one 3x3 problem per object."""
    out = features.withColumn("_p", _principal(*[f"m_{a}{b}" for i, a in enumerate(AXES) for b in AXES[i:]]))
    l1, l2, l3 = (F.greatest(F.col(f"_p.l{i}"), F.lit(0.0)) for i in (1, 2, 3))
    ratio = lambda a, b: F.when(b > 1e-12, F.sqrt(a / b)).otherwise(F.lit(0.0))
    product = F.pow(l1 * l2 * l3, F.lit(1 / 6))
    size = lambda x: F.when(product > 1e-12, 2 * F.col("EquivalentSphericalRadius") * F.sqrt(x) / product).otherwise(F.lit(0.0))
    return out.withColumns({
        **{f"PrincipalMoments-{i}": x for i, x in enumerate((l1, l2, l3))}, "Flatness": ratio(l2, l1), "Elongation": ratio(l3, l2),
        **{f"EquivalentEllipsoidDiameter-{i}": size(x) for i, x in enumerate((l1, l2, l3))},
        **{f"PrincipalAxes-{i}-{a}": F.col(f"_p.a{i + 1}{a}") for i in range(3) for a in AXES}}).drop("_p")


def oriented_box(voxels: DataFrame, principal: DataFrame, scale: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Each object's box along its principal axes: its least corner and its size in the axes' coordinates, the axes, and the eight corners in space.

    Corner ``k`` has the upper end of axis ``i`` if bit ``i`` of ``k`` is set.
    """
    axes = principal.select(*OBJECT, *[F.col(f"PrincipalAxes-{i}-{a}").alias(f"u{i}{a}") for i in range(3) for a in AXES])
    rows = voxels.where("label <> 0").join(axes, list(OBJECT))
    along = [sum((F.col(a) * F.lit(float(s)) * F.col(f"u{i}{a}") for a, s in zip(AXES, scale)), F.lit(0.0)) for i in range(3)]
    directions = [F.first(f"u{i}{a}").alias(f"u{i}{a}") for i in range(3) for a in AXES]
    out = rows.groupBy(*OBJECT).agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(along) for n, f in (("lo", F.min), ("hi", F.max))], *directions)
    corner = lambda k, a: sum((F.col(f"{'hi' if k >> i & 1 else 'lo'}{i}") * F.col(f"u{i}{a}") for i in range(3)), F.lit(0.0))
    return out.select(*OBJECT, *[F.col(f"lo{i}").alias(f"OrientedBoundingBoxOrigin-{i}") for i in range(3)], *[(F.col(f"hi{i}") - F.col(f"lo{i}")).alias(f"OrientedBoundingBoxSize-{i}") for i in range(3)],
                      *[F.col(f"u{i}{a}").alias(f"OrientedBoundingBoxDirection-{i}-{a}") for i in range(3) for a in AXES], *[corner(k, a).alias(f"OrientedBoundingBoxVertices-{k}-{a}") for k in range(8) for a in AXES])


def _farthest(p: np.ndarray) -> float:
    """Largest squared distance between two rows of ``p``, exact: pairs of blocks, those with the largest bound first, until no bound exceeds what was found."""
    size, todo, blocks = max(64, math.isqrt(len(p))), [p], []
    while todo:
        q = todo.pop()
        if len(q) <= size:
            blocks.append(q)
            continue
        q = q[np.argsort(q[:, np.ptp(q, axis=0).argmax()], kind="stable")]
        todo += [q[: len(q) // 2], q[len(q) // 2 :]]
    lo, hi = np.array([q.min(0) for q in blocks]), np.array([q.max(0) for q in blocks])
    i, j = np.triu_indices(len(blocks))
    bound = (np.maximum(hi[i] - lo[j], hi[j] - lo[i]) ** 2).sum(1)
    best = 0.0
    for k in np.argsort(-bound):
        if bound[k] <= best:
            break
        best = max(best, float(((blocks[i[k]][:, None] - blocks[j[k]][None]) ** 2).sum(-1).max()))
    return best


def feret_diameter(voxels: DataFrame, scale: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Largest distance between two voxels of an object.

    The farthest pair lies among the voxels that end an object's lines along x and along
    y; their blocks are compared by the bounds of their boxes, so few pairs are formed.
    """
    ends = voxels.where("label <> 0").groupBy(*OBJECT, "z", "y").agg(F.array_distinct(F.array(F.min("x"), F.max("x"))).alias("xs"))
    ends = ends.select(*OBJECT, "z", "y", F.explode("xs").alias("x"))
    ends = ends.groupBy(*OBJECT, "z", "x").agg(F.array_distinct(F.array(F.min("y"), F.max("y"))).alias("ys"))
    ends = ends.select(*OBJECT, "z", F.explode("ys").alias("y"), "x")

    def widest(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[list(OBJECT)].head(1).assign(FeretDiameter=math.sqrt(_farthest(rows[list(AXES)].to_numpy("float64") * np.array(scale, "float64"))))

    kinds = [voxels.schema[c] for c in OBJECT]
    return ends.groupBy(*OBJECT).applyInPandas(widest, T.StructType([*kinds, T.StructField("FeretDiameter", T.DoubleType())]))


def intensity_features(labels: DataFrame, image: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, extremes and where they are (ties: smallest z, y, x), sum, sample variance, population skewness and excess kurtosis per object, and per ``by`` columns of the image (channels, say), all in one join."""
    rows = labels.where("label <> 0").join(image, ["roi", *AXES])
    v, at = F.col("value").cast("double"), F.struct(*AXES)
    first = F.struct(*[(-F.col(a)).alias(a) for a in AXES])
    return rows.groupBy(*OBJECT, *by).agg(
        F.avg(v).alias("Mean"), F.percentile(v, F.lit(0.5)).alias("Median"), F.min(v).alias("Minimum"), F.max(v).alias("Maximum"), F.sum(v).alias("Sum"),
        F.var_samp(v).alias("Variance"), F.stddev_samp(v).alias("StandardDeviation"), F.skewness(v).alias("Skewness"), F.kurtosis(v).alias("Kurtosis"),
        F.max_by(at, F.struct(v, first)).alias("MaximumIndex"), F.min_by(at, F.struct(v, at)).alias("MinimumIndex"))


def weighted_moments(labels: DataFrame, image: DataFrame, scale: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Centre of gravity and second moments weighted by intensity; null where the total is zero."""
    rows = labels.where("label <> 0").join(image, ["roi", *AXES])
    w = F.col("value").cast("double")
    p = {a: F.col(a) * F.lit(float(s)) for a, s in zip(AXES, scale)}
    total = F.nullif(F.sum(w), F.lit(0.0))
    mean = {a: F.sum(w * p[a]) / total for a in AXES}
    return rows.groupBy(*OBJECT).agg(*[mean[a].alias(f"CenterOfGravity-{a}") for a in AXES],
                                     *[(F.sum(w * p[a] * p[b]) / total - mean[a] * mean[b]).alias(f"m_{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]])


def weighted_principal(moments: DataFrame) -> DataFrame:
    """Principal moments, axes, elongation and flatness beside :func:`weighted_moments`, named ``Weighted…``; null without weight."""
    sized = moments.withColumn("EquivalentSphericalRadius", F.lit(1.0))
    out = with_principal(sized)
    wanted = [n for n in out.columns if n.startswith(("PrincipalMoments", "PrincipalAxes")) or n in ("Elongation", "Flatness")]
    named = [F.when(F.col("m_zz").isNotNull(), F.col(f"`{n}`")).alias(f"Weighted{n}") for n in wanted]
    return out.select(*[F.col(f"`{n}`") for n in moments.columns], *named)


def path_along(labels: DataFrame, target: DataFrame, axis: str = "z", spacing: float = 1.0) -> DataFrame:
    """For each voxel of an object, the length of the way through ``target(roi, z, y, x)`` voxels from the start of its line along an axis, itself included."""
    rest = [a for a in AXES if a != axis]
    both = labels.select("roi", *AXES, "label").join(target.select("roi", *AXES).distinct().withColumn("_on", F.lit(1)), ["roi", *AXES], "full")
    w = Window.partitionBy("roi", *rest).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("value", F.sum(F.coalesce("_on", F.lit(0))).over(w) * F.lit(float(spacing)))
    return out.where("label <> 0").select("roi", *AXES, "label", "value")


def _information(cells: DataFrame, keys: Sequence[str], a: str, b: str, name: str) -> DataFrame:
    """Mutual information, and over the mean entropy, from ``cells(keys, a, b, n)``."""
    total, per_a, per_b = Window.partitionBy(*keys), Window.partitionBy(*keys, a), Window.partitionBy(*keys, b)
    p = cells.withColumns({"p": F.col("n") / F.sum("n").over(total), "pa": F.sum("n").over(per_a) / F.sum("n").over(total), "pb": F.sum("n").over(per_b) / F.sum("n").over(total)})
    mi = F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb"))))
    half = -(F.sum(F.col("p") * F.ln("pa")) + F.sum(F.col("p") * F.ln("pb"))) / 2
    return p.groupBy(*keys).agg(mi.alias(name), F.when(half > 1e-12, mi / half).alias(f"{name}Normalized"))


def _kendall(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kendall tau-b per group from ``pairs(keys, u, v, n)``, by inversion counts over the bits of the ranks.

    Two ranks of u differ first at one bit: there the pair meets once, in the block of
    the higher bits, and prefix sums over v count the concordant less the discordant.
    The sums run inside buckets of v ranks and over the buckets' totals.
    """
    n = F.col("n")
    totals = pairs.groupBy(*keys).agg(F.max(F.coalesce(F.isnan("u") | F.isnan("v"), F.lit(False))).alias("nan"))
    for x, t in (("u", "tu"), ("v", "tv")):
        each = pairs.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.sum("n").alias("n"))
        totals = totals.join(each.groupBy(*keys).agg((F.sum("n") * F.sum("n") - F.sum(n * n)).alias(t)), list(keys), "left")
    wu, wv = Window.partitionBy(*keys).orderBy("u"), Window.partitionBy(*keys).orderBy("v")
    ranks = pairs.where("u is not null and v is not null").select(*keys, "n", F.sum("n").over(wu).alias("ru"), F.sum("n").over(wv).alias("rv"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    bits = ranks.select(*keys, "n", "ru", "rv", F.explode(F.sequence(F.lit(0), F.floor(F.log2("all")).cast("int"))).alias("bit"))
    high = F.expr("shiftright(ru, bit) & 1") == 1
    block = [*keys, "bit", "block"]
    cells = bits.groupBy(*keys, "bit", F.expr("shiftright(ru, bit + 1)").alias("block"), F.expr("shiftright(rv, 12)").alias("bucket"), "rv").agg(F.sum(F.when(high, 0).otherwise(n)).alias("low"), F.sum(F.when(high, n).otherwise(0)).alias("high"))
    buckets = cells.groupBy(*block, "bucket").agg(F.sum("low").alias("in"))
    buckets = buckets.withColumns({"before": F.sum("in").over(Window.partitionBy(*block).orderBy("bucket")) - F.col("in"), "lows": F.sum("in").over(Window.partitionBy(*block))}).drop("in")
    upto = F.col("before") + F.sum("low").over(Window.partitionBy(*block, "bucket").orderBy("rv"))
    net = cells.join(buckets, [*block, "bucket"]).select(*keys, (F.col("high") * (upto - F.col("low") - (F.col("lows") - upto))).alias("net"))
    s = net.groupBy(*keys).agg((2 * F.sum("net")).alias("s"))
    tau = F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("s") / F.sqrt(F.col("tu").cast("double") * F.col("tv")))
    return totals.join(s, list(keys), "left").select(*keys, F.when((F.col("tu") > 0) & (F.col("tv") > 0), tau).alias("KendallTau"))


def pair_statistics(rows: DataFrame, keys: Sequence[str], n_bins: int = 10, want: Sequence[str] | None = None) -> DataFrame:
    """Pearson, Spearman, Kendall tau-b, chi-square and mutual information of ``rows(keys, u, v)`` in each group; null where undefined.

    The rows are read once: everything is computed from the counts of each group's pairs
    of values, which are written. ``want`` names the statistics to be computed, all by default.
    """
    wanted = lambda *names: want is None or any(x.startswith(names) for x in want)
    keys, w = list(keys), F.col("n")
    pairs = durable(rows.groupBy(*keys, "u", "v").agg(F.count(F.lit(1)).alias("n")), "value-pairs")

    def correlation(table: DataFrame, a: str, b: str, name: str) -> DataFrame:
        """Of the rows with both values, about their means, so that large values lose no digits."""
        both = table.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        per = Window.partitionBy(*keys)
        mean = lambda x: F.sum(w * F.col(x)).over(per) / F.sum("n").over(per)
        apart = both.select(*keys, "n", (F.col(a) - mean(a)).alias("da"), (F.col(b) - mean(b)).alias("db"))
        spread = F.sum(w * F.col("da") * F.col("da")) * F.sum(w * F.col("db") * F.col("db"))
        r = F.sum(w * F.col("da") * F.col("db")) / F.sqrt(spread)
        return apart.groupBy(*keys).agg(F.when((spread > 0) & ~F.isnan(r), r).alias(name))

    parts = [correlation(pairs, "u", "v", "PearsonR")] if wanted("Pearson") else []
    if wanted("Spearman"):
        wu, wv = Window.partitionBy(*keys).orderBy("u"), Window.partitionBy(*keys).orderBy("v")
        gu, gv = Window.partitionBy(*keys, "u"), Window.partitionBy(*keys, "v")
        ranks = pairs.withColumns({"ru": F.sum("n").over(wu) - (F.sum("n").over(gu) - 1) / 2, "rv": F.sum("n").over(wv) - (F.sum("n").over(gv) - 1) / 2})
        parts.append(correlation(ranks, "ru", "rv", "SpearmanR"))
    if wanted("Kendall"):
        parts.append(_kendall(pairs, keys))
    if wanted("Chi2", "MutualInfoBins"):
        ends = pairs.groupBy(*keys).agg(*[f(x).alias(f"{e}_{x}") for x in "uv" for e, f in (("lo", F.min), ("hi", F.max))])
        place = lambda x: F.when(F.col(f"hi_{x}") > F.col(f"lo_{x}"), F.least(F.floor((F.col(x) - F.col(f"lo_{x}")) / (F.col(f"hi_{x}") - F.col(f"lo_{x}")) * n_bins), F.lit(n_bins - 1)))
        binned = pairs.join(ends, keys).select(*keys, "n", place("u").alias("a"), place("v").alias("b")).where("a is not null and b is not null").groupBy(*keys, "a", "b").agg(F.sum("n").alias("n"))
        total, pa_, pb = Window.partitionBy(*keys), Window.partitionBy(*keys, "a"), Window.partitionBy(*keys, "b")
        e = binned.withColumns({"e": F.sum("n").over(pa_) * F.sum("n").over(pb) / F.sum("n").over(total), "all": F.sum("n").over(total)})
        whole = (F.count_distinct("a") == n_bins) & (F.count_distinct("b") == n_bins)
        parts.append(e.groupBy(*keys).agg(F.when(whole, F.sum(w * w / F.col("e")) - F.max("all")).alias("Chi2")))  # sum of o^2/e less the total, empty cells included
        parts.append(_information(binned, keys, "a", "b", "MutualInfoBins"))
    if want is None or any(x in ("MutualInfo", "MutualInfoNormalized") for x in want):
        parts.append(_information(pairs, keys, "u", "v", "MutualInfo"))
    out = pairs.select(*keys).distinct()
    for part in parts:
        out = out.join(part, keys, "left")
    return out


def colocalization(labels: DataFrame, first: DataFrame, second: DataFrame, n_bins: int = 10) -> DataFrame:
    """:func:`pair_statistics` of two channels inside each object."""
    rows = labels.where("label <> 0").join(first.withColumnRenamed("value", "u"), ["roi", *AXES]).join(second.withColumnRenamed("value", "v"), ["roi", *AXES])
    return pair_statistics(rows.select(*OBJECT, F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")), OBJECT, n_bins)


def _lower_envelope(f: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each row of ``f`` and place in ``to`` the least of ``f[row, i] + (place - at[i]) ** 2``; ``at`` and ``to`` rise.

    Each finite value is a parabola; a stack per row holds those of its lower envelope and
    where each begins. All rows go through the places together.
    """
    rows, n = f.shape
    held, begin, top = np.zeros((rows, n), np.int64), np.full((rows, n + 1), np.inf), np.full(rows, -1)
    for i in range(n):
        open_ = np.flatnonzero(np.isfinite(f[:, i]))
        while len(open_):
            k = top[open_]
            last = held[open_, np.maximum(k, 0)]
            with np.errstate(divide="ignore", invalid="ignore"):
                meet = ((f[open_, i] + at[i] ** 2) - (f[open_, last] + at[last] ** 2)) / (2 * (at[i] - at[last]))
            meet = np.where(k < 0, -np.inf, meet)
            fits = (k < 0) | (meet > begin[open_, np.maximum(k, 0)])
            put = open_[fits]
            top[put] += 1
            held[put, top[put]], begin[put, top[put]] = i, meet[fits]
            open_ = open_[~fits]
            top[open_] -= 1
    out, k = np.full((rows, len(to)), np.inf), np.zeros(rows, np.int64)
    some = np.flatnonzero(top >= 0)
    for j, place in enumerate(to):
        while True:
            on = some[(k[some] < top[some]) & (begin[some, np.minimum(k[some] + 1, n)] <= place)]
            if not len(on):
                break
            k[on] += 1
        v = held[some, k[some]]
        out[some, j] = f[some, v] + (place - at[v]) ** 2
    return out


def border_distance(voxels: DataFrame, scale: Sequence[float] = (1.0, 1.0, 1.0), squared: bool = False) -> DataFrame:
    """Distance of each voxel with a label to the nearest voxel without one in its roi, inside positive, else 0; infinite if its roi has none.

    Separable: the lower envelope of parabolas along z and y inside each plane of one x,
    then along x inside each plane of one y, all lines of a plane together. A row between the two is a line along
    z with the squared distances at the roi's z places as an array, so voxels are shuffled once and
    lines once, and no row is made for a place without a voxel's line. A plane is one
    task's work: an image's side squared, not its volume.
    """
    sz, sy, sx = (float(s) for s in scale)
    v = voxels.select("roi", *[F.col(a).cast("long").alias(a) for a in AXES], (F.col("label") != 0).alias("inside"))
    places = v.groupBy("roi").agg(F.array_sort(F.collect_set("z")).alias("zs"), F.array_sort(F.collect_set("y")).alias("ys"))
    planes = v.select("roi", "x").distinct().join(places, "roi").toDF("p_roi", "p_x", "zs", "ys")
    roi = voxels.schema["roi"]
    lines = T.StructType([roi, T.StructField("y", T.LongType()), T.StructField("x", T.LongType()), T.StructField("d", T.ArrayType(T.DoubleType())),
                          T.StructField("at", T.ArrayType(T.LongType())), T.StructField("z", T.ArrayType(T.LongType())), T.StructField("inside", T.ArrayType(T.BooleanType()))])

    def across(rows: pa.Table, plane: pa.Table) -> pa.Table:
        zs, ys = (np.array(plane[c][0].as_py()) for c in ("zs", "ys"))
        z, y, inside = (rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("z", "y", "inside"))
        at, line = np.searchsorted(zs, z), np.searchsorted(ys, y)
        f = np.full((len(ys), len(zs)), np.inf)
        f[line[~inside], at[~inside]] = 0
        d = _lower_envelope(_lower_envelope(f, zs * sz, zs * sz).T, ys * sy, ys * sy).T
        order = np.lexsort((at, line))
        cuts = np.searchsorted(line[order], np.arange(len(ys) + 1))
        wanted = np.flatnonzero(np.isfinite(d).any(1) | (np.diff(cuts) > 0))
        parts = [order[cuts[i] : cuts[i + 1]] for i in wanted]
        lists = lambda values, kind: pa.array([values[p] for p in parts], pa.list_(kind))
        same = lambda c, kind: pa.array([plane[f"p_{c}"][0].as_py()] * len(wanted), kind)
        return pa.table({"roi": same("roi", plane.schema.field("p_roi").type), "y": pa.array(ys[wanted], pa.int64()), "x": same("x", pa.int64()), "d": pa.array(list(d[wanted]), pa.list_(pa.float64())),
                         "at": lists(at, pa.int64()), "z": lists(z, pa.int64()), "inside": lists(inside, pa.bool_())})

    found = T.StructType([roi, *[T.StructField(a, T.LongType()) for a in AXES], T.StructField("value", T.DoubleType())])

    def along(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("x").combine_chunks()
        x = rows["x"].to_numpy()
        d = rows["d"].combine_chunks().flatten().to_numpy().reshape(len(x), -1)
        counts = pc.list_value_length(rows["z"]).to_numpy()
        flat = {c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("at", "z", "inside")}
        own = np.repeat(np.arange(len(x)), counts)
        asked = np.unique(own)
        out = _lower_envelope(np.ascontiguousarray(d.T), x * sx, x[asked] * sx)
        value = np.where(flat["inside"], out[flat["at"], np.searchsorted(asked, own)], 0.0) if len(own) else np.array([])
        same = lambda c: pa.array([rows[c][0].as_py()] * len(own), rows.schema.field(c).type)
        return pa.table({"roi": same("roi"), "z": pa.array(flat["z"], pa.int64()), "y": same("y"), "x": pa.array(x[own], pa.int64()), "value": pa.array(value if squared else np.sqrt(value), pa.float64())})

    out = v.groupBy("roi", "x").cogroup(planes.groupBy("p_roi", "p_x")).applyInArrow(across, lines).groupBy("roi", "y").applyInArrow(along, found)
    return out.select("roi", *[F.col(a).cast(voxels.schema[a].dataType) for a in AXES], "value")


def distance_features(labels: DataFrame, distances: DataFrame, centroids: DataFrame, scale: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """A distance table summarised over each object: at the centroid's nearest voxel, minimum, maximum, median and where the extremes are."""
    stats = intensity_features(labels, distances).select(*OBJECT, "Minimum", "Maximum", "Median", "MinimumIndex", "MaximumIndex")
    at = centroids.select(*OBJECT, *[F.round(F.col(f"Centroid-{a}") / float(s)).cast("int").alias(a) for a, s in zip(AXES, scale)])
    return stats.join(at.join(distances, ["roi", *AXES], "left").select(*OBJECT, F.col("value").alias("Centroid")), list(OBJECT), "left")


def parents(children: DataFrame, parent_image: DataFrame, name: str) -> DataFrame:
    """``parent.{name}`` of each object: the label of the parent image with the most of its voxels (0 if background), ties to the largest."""
    rows = children.where("label <> 0").join(parent_image.withColumnRenamed("label", "parent"), ["roi", *AXES])
    n = rows.groupBy(*OBJECT, "parent").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*OBJECT).agg(F.max_by("parent", F.struct("n", "parent")).alias(f"parent.{name}"))


def keep_labels(voxels: DataFrame, labels: DataFrame, keep: bool = True) -> DataFrame:
    """Voxels whose label is not kept (or, without ``keep``, is listed) become background."""
    listed = labels.select("roi", "label", F.lit(True).alias("_hit")).distinct()
    hit = F.coalesce("_hit", F.lit(False))
    return voxels.join(listed, ["roi", "label"], "left").withColumn("label", F.when(hit if keep else ~hit, F.col("label")).otherwise(F.lit(0))).drop("_hit").select(*voxels.columns)


def masked(image: DataFrame, labels: DataFrame) -> DataFrame:
    """Image values outside every label as 0, type kept."""
    inside = labels.where("label <> 0").select("roi", *AXES, F.lit(True).alias("_in"))
    kind = image.schema["value"].dataType
    return image.join(inside, ["roi", *AXES], "left").withColumn("value", F.when(F.col("_in"), F.col("value")).otherwise(F.lit(0)).cast(kind)).drop("_in").select(*image.columns)


def resampled(voxels: DataFrame, factors: Sequence[int], up: bool = False) -> DataFrame:
    """Nearest-neighbour resampling by whole factors: every k-th voxel, or each repeated."""
    if not up:
        keep = F.lit(True)
        for a, k in zip(AXES, factors):
            keep = keep & (F.col(a) % k == 0)
        return voxels.where(keep).withColumns({a: F.floor(F.col(a) / k).cast("int") for a, k in zip(AXES, factors)})
    out = voxels
    for a, k in zip(AXES, factors):
        out = out.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(a, (F.col(a) * k + F.col("_s")).cast("int")).drop("_s")
    return out


def resampled_to(voxels: DataFrame, factors: Sequence[float], shape: Sequence[int], centred: bool = True) -> DataFrame:
    """Nearest-neighbour resampling by any factors, over 1 down and under 1 up, of images of ``shape`` voxels; the result has ``int(n / factor)`` of them.

    Place ``i`` of the result takes the voxel around ``i * factor``, moved by half of both voxels' difference if
    ``centred``, so that images cover the same space. Every voxel is turned into the
    interval of places that take it (none, one or several), so nothing is joined; both ends are
    tested with the forward formula, so rounding cannot leave a gap.
    """
    out = voxels
    for a, f, n in zip(AXES, factors, shape):
        f, shift = float(f), 0.5 * float(f) if centred else 0.5
        low, high = (F.floor((F.col(a) + k - shift) / f).cast("int") for k in (-0.001, 1.001))
        places = F.filter(F.sequence(low, high + 1), lambda i: (F.floor(i * f + shift) == F.col(a)) & (i >= 0) & (i < int(n / f)))  # noqa: B023
        out = out.withColumn(a, F.explode(places))
    return out


def pyramid_schedule(scale: Sequence[float], levels: int) -> list[tuple[int, ...]]:
    """Cumulative shrink factors of ``levels`` levels: each step halves the axes whose spacing fits one and a half times or more in the widest, or, near isotropy, all."""
    now, total, out = list(scale), [1] * len(scale), []
    for _ in range(levels):
        step = [2 if max(now) / s >= 1.5 else 1 for s in now]
        step = step if 2 in step else [2] * len(step)
        now, total = [s * k for s, k in zip(now, step)], [t * k for t, k in zip(total, step)]
        out.append(tuple(total))
    return out


def block_mean(image: DataFrame, factors: Sequence[int]) -> DataFrame:
    """Mean of blocks of voxels."""
    return image.groupBy("roi", *[F.floor(F.col(a) / k).cast("int").alias(a) for a, k in zip(AXES, factors)]).agg(F.avg("value").alias("value"))


def _at_levels(table: DataFrame, schedule: Sequence[Sequence[int]]) -> DataFrame:
    """Each row once per level, with the level's number and its factors and offsets per axis.

    Level by level the voxel in the middle of a block is taken (the later of two), so offsets add up.
    """
    rows, offset, last = [], [0, 0, 0], [1, 1, 1]
    for m, total in enumerate(schedule, 1):
        offset = [o + k * ((t // k) // 2) for o, k, t in zip(offset, last, total)]
        rows.append(F.struct(F.lit(m).alias("level"), *[F.lit(int(v)).alias(f"{n}_{a}") for n, vs in (("k", total), ("o", offset)) for a, v in zip(AXES, vs)]))
        last = list(total)
    return table.withColumn("_m", F.explode(F.array(*rows))).withColumn("level", F.col("_m.level"))


def label_pyramid(voxels: DataFrame, schedule: Sequence[Sequence[int]], shape: Sequence[int] | None = None) -> DataFrame:
    """All levels of a label image, as ``level`` beside its columns, in one pass: at every step of the schedule the voxel in the middle of each block stays.

    ``shape`` leaves out blocks that are not whole, as halving sizes does.
    """
    rows = _at_levels(voxels, schedule)
    for i, a in enumerate(AXES):
        k, o = F.col(f"_m.k_{a}"), F.col(f"_m.o_{a}")
        place = F.floor((F.col(a) - o) / k).cast("int")
        ok = (F.pmod(F.col(a) - o, k) == 0) & (F.col(a) >= o)
        ok = ok if shape is None else ok & (place < F.floor(F.lit(shape[i]) / k))
        rows = rows.where(ok).withColumn(a, place)
    return rows.select("level", *voxels.columns)


def image_pyramid(image: DataFrame, schedule: Sequence[Sequence[int]]) -> DataFrame:
    """Means of blocks at all levels, ``(level, roi, z, y, x, value)``: one pass, aggregated before the shuffle."""
    rows = _at_levels(image, schedule)
    return rows.groupBy("level", "roi", *[F.floor(F.col(a) / F.col(f"_m.k_{a}")).cast("int").alias(a) for a in AXES]).agg(F.avg("value").alias("value"))


def scale_boxes(boxes: DataFrame, ratio: Sequence[float]) -> DataFrame:
    """Box bounds at another level: times the ratio of scales, rounded."""
    return boxes.withColumns({f"{a}_{e}": F.round(F.col(f"{a}_{e}") * float(r)).cast("int") for a, r in zip(AXES, ratio) for e in ("lower", "upper")})


def stacked(images: DataFrame, channels: Sequence[str]) -> DataFrame:
    """``(roi, z, y, x, values)`` from ``images(roi, c, z, y, x, value)``: one row per voxel with the named channels' values in their order, null where one is missing."""
    found = images.where(F.col("c").isin(list(channels))).groupBy("roi", *AXES).agg(*[F.max(F.when(F.col("c") == ch, F.col("value"))).alias(f"_{i}") for i, ch in enumerate(channels)])
    return found.select("roi", *AXES, F.array(*[F.col(f"_{i}") for i in range(len(channels))]).alias("values"))


def crop(voxels: DataFrame, boxes: DataFrame, isolate: bool = False, cell: int = 16) -> DataFrame:
    """Voxels inside each object's box ``(roi, label as object, {axis}_lower, {axis}_upper exclusive)``, moved to its origin; ``isolate`` keeps the object's own voxels.

    A range join on a grid of cubes: a box is listed by the cubes it meets, a voxel lies in
    one, so it meets the boxes of its cube alone, and each once; the box is then tested.
    """
    cells = [F.explode(F.sequence(F.floor(F.col(f"{a}_lower") / cell), F.floor((F.col(f"{a}_upper") - 1) / cell))).alias(f"_{a}") for a in AXES]
    b = boxes.where(" and ".join(f"{a}_upper > {a}_lower" for a in AXES)).select("roi", F.col("label").alias("object"), *[f"{a}_{e}" for a in AXES for e in ("lower", "upper")])
    for at in cells:
        b = b.select("*", at)
    rows = voxels.withColumns({f"_{a}": F.floor(F.col(a) / cell) for a in AXES}).join(b, ["roi", *[f"_{a}" for a in AXES]])
    for a in AXES:
        rows = rows.where((F.col(a) >= F.col(f"{a}_lower")) & (F.col(a) < F.col(f"{a}_upper")))
    rows = rows.where("label = object") if isolate else rows
    return rows.withColumns({a: F.col(a) - F.col(f"{a}_lower") for a in AXES}).drop(*[f"{a}_{e}" for a in AXES for e in ("lower", "upper")], *[f"_{a}" for a in AXES])


def max_projection(image: DataFrame, axis: str = "z") -> DataFrame:
    return image.groupBy("roi", *[a for a in AXES if a != axis]).agg(F.max("value").alias("value"))


def centred(image: DataFrame, size: dict[str, int], extent: dict[str, int]) -> DataFrame:
    """Centre pad or crop to ``size`` given the present ``extent`` of each axis."""
    out = image.withColumns({a: F.col(a) + (n - extent[a]) // 2 for a, n in size.items()})
    for a, n in size.items():
        out = out.where((F.col(a) >= 0) & (F.col(a) < n))
    return out
