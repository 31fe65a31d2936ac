"""Places of wells and sites: plate indices, grids by sort order, world coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuemill.operators.ranked import numbered


def well_row(well: Column) -> Column:
    """Row of a well like ``C07``: A is 1."""
    return F.ascii(well) - 64


def well_column(well: Column) -> Column:
    return F.substring(well, 2, 10).cast("int")


def well_grid(df: DataFrame, well: str = "well") -> DataFrame:
    """``iy`` and ``ix`` of each row's well, from the smallest that occur."""
    least = df.agg(F.min(well_row(F.col(well))).alias("_y0"), F.min(well_column(F.col(well))).alias("_x0"))
    out = df.crossJoin(F.broadcast(least))
    return out.withColumns({"iy": well_row(F.col(well)) - F.col("_y0"), "ix": well_column(F.col(well)) - F.col("_x0")}).drop("_y0", "_x0")


def site_grid(sites: DataFrame, site: str, form: str = "square", left_to_right: bool = True, aspect: float = 2.0) -> DataFrame:
    """``iy`` and ``ix`` of sites, one row each, in the order of their names.

    ``line`` is one row; ``square`` has as many lines as places in one; ``rect`` has about
    ``aspect`` times as many places along the direction that is filled last. Filled
    along x first unless ``left_to_right`` is given, which fills along y first.
    """
    rows = numbered(sites, [site], "_i")
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.crossJoin(F.broadcast(n))
    ny = {"line": F.col("_n"), "square": F.ceil(F.sqrt("_n")), "rect": F.ceil(F.sqrt(F.col("_n") * aspect))}[form].cast("long")
    nx = {"line": F.lit(1), "square": F.ceil(F.sqrt("_n")), "rect": F.ceil(F.col("_n") / ny)}[form].cast("long")
    slow, fast = F.floor(F.col("_i") / nx), F.col("_i") % nx
    a, b = (fast, slow) if left_to_right else (slow, fast)
    return rows.withColumns({"iy": a.cast("long"), "ix": b.cast("long")}).drop("_i", "_n")


def site_offsets(df: DataFrame, roi: str = "roi") -> DataFrame:
    """``well``, and ``wx`` and ``wy`` as a roi's name like ``B02_px+0010_py-0004`` gives them; null if it does not."""
    number = lambda axis: F.expr(f"try_cast(nullif(regexp_extract(`{roi}`, 'p{axis}([-+][0-9]+)', 1), '') as int)")
    return df.withColumns({"well": F.get(F.split(F.col(roi), "_"), F.lit(0)), "wx": number("x"), "wy": number("y")})


def to_world(df: DataFrame, scale: float, roi: str = "roi", y: str = "y", x: str = "x") -> DataFrame:
    """Coordinates moved by their roi's offsets times a scale; rois without offsets stay."""
    placed = site_offsets(df.select(*[F.col(f"`{c}`") for c in df.columns]), roi)
    moved = {x: F.col(x) + F.coalesce(F.col("wx") * scale, F.lit(0.0)), y: F.col(y) + F.coalesce(F.col("wy") * scale, F.lit(0.0))}
    return placed.withColumns(moved).select(*[F.col(f"`{c}`") for c in df.columns])
