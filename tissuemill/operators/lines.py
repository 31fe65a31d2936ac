"""Voxels as runs along an axis: one row per stretch of one label on a line, from which paths, faces and touch areas follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def _rest(axis: str) -> list[str]:
    return [a for a in AXES if a != axis]


def areas(scale: Sequence[float]) -> dict[str, float]:
    """Area of a voxel's face across each axis."""
    sz, sy, sx = (float(s) for s in scale)
    return {"z": sy * sx, "y": sx * sz, "x": sy * sz}


def runs(voxels: DataFrame, axis: str = "z", site: str = "roi", value: str | Column = "label") -> DataFrame:
    """``(site, two other axes, start, end, label)``: maximal stretches of neighbouring voxels of one label along an axis, ``end`` exclusive.

    One shuffle by line: the window that marks where a stretch begins and the grouping of its voxels share it.
    """
    line = [site, *_rest(axis)]
    w = Window.partitionBy(*line).orderBy(axis)
    v = voxels.select(*line, axis, (F.col(value) if isinstance(value, str) else value).alias("label"))
    begins = F.coalesce((F.lag("label").over(w) != F.col("label")) | (F.lag(axis).over(w) + 1 != F.col(axis)), F.lit(True))
    numbered = v.withColumn("_b", begins.cast("int")).withColumn("_run", F.sum("_b").over(w))
    return numbered.groupBy(*line, "_run").agg(F.min(axis).alias("start"), (F.max(axis) + 1).alias("end"), F.first("label").alias("label")).drop("_run")


def perimeter(voxels: DataFrame, scale: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Summed area of an object's faces towards another label or an absent voxel: two for each of its runs along each axis; differs from an image library's smooth estimate."""
    parts = None
    for axis, area in areas(scale).items():
        faces = runs(voxels, axis).where("label <> 0").groupBy("roi", "label").agg((2 * F.count(F.lit(1)) * F.lit(area)).alias("area"))
        parts = faces if parts is None else parts.union(faces)
    return parts.groupBy("roi", "label").agg(F.sum("area").alias("Perimeter"))


def touch_areas(voxels: DataFrame, scale: Sequence[float] = (1.0, 1.0, 1.0), site: str = "site") -> DataFrame:
    """``(site, src, dst, weight)``: the area on which two labels touch, in both directions, background included; a run touches the one that begins where it ends."""
    faces = None
    for axis, area in areas(scale).items():
        r = runs(voxels, axis, site)
        w = Window.partitionBy(site, *_rest(axis)).orderBy("start")
        near = r.select(site, "label", F.when(F.lead("start").over(w) == F.col("end"), F.lead("label").over(w)).alias("other"), F.lit(area).alias("area")).where("other is not null")
        faces = near if faces is None else faces.union(near)
    half = faces.groupBy(site, "label", "other").agg(F.sum("area").alias("area"))
    both = half.select(site, F.col("label").alias("src"), F.col("other").alias("dst"), "area").union(half.select(site, "other", "label", "area"))
    return both.groupBy(site, "src", "dst").agg(F.sum("area").alias("weight"))


def inside_runs(mask: DataFrame, axis: str = "z", site: str = "roi") -> DataFrame:
    """``(site, two other axes, inside array<struct<start, end>>)``: per line, the stretches of a mask's voxels (label not 0), in order."""
    r = runs(mask.where("label <> 0"), axis, site, F.lit(1))
    return r.groupBy(site, *_rest(axis)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("inside"))


def with_paths(voxels: DataFrame, mask: DataFrame, axis: str = "z", spacing: float = 1.0, first: int = 0, inside: str = "EmbryoPath", outside: str = "MediumPath") -> DataFrame:
    """Voxels with the length of the way to them along an axis, from place ``first``, that runs inside a mask and outside it, themselves included.

    The mask comes as runs, one row per line with its stretches as an array, and is joined by line: rows per run, not per voxel of the mask.
    """
    lines = inside_runs(mask, axis)
    upto = F.col(axis) + 1
    length = F.aggregate("inside", F.lit(0).cast("long"), lambda acc, r: acc + F.greatest(F.least(r["end"], upto) - r["start"], F.lit(0)))
    n = F.coalesce(length, F.lit(0).cast("long"))
    out = voxels.join(lines, ["roi", *_rest(axis)], "left").withColumn("_n", n)
    return out.select(*[F.col(f"`{c}`") for c in voxels.columns], (F.col("_n") * F.lit(float(spacing))).alias(inside), ((upto - F.lit(first) - F.col("_n")) * F.lit(float(spacing))).alias(outside))
