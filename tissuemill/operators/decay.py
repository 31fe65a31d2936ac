"""Intensity-decay models: curves, grouped fits, prediction and correction."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tissuemill.functions.durable import durable
from tissuemill.operators import lines

# Curves of one or two inputs; p is the parameter array of a model row.
CURVES = {
    "linear": lambda p, xs: p[len(xs)] + _dot(p, xs),
    "log_linear": lambda p, xs: F.exp(p[len(xs)] + _dot(p, xs)),
    "exponential": lambda p, xs: p[len(xs)] * F.exp(_dot(p, xs)),
    "exp_fit_linear": lambda p, xs: p[len(xs)] * F.exp(_dot(p, xs)),
    "exponential_offset": lambda p, xs: p[len(xs)] * F.exp(_dot(p, xs)) + p[len(xs) + 1],
    "power": lambda p, xs: p[1] * F.pow(xs[0], p[0]),
    "power_offset": lambda p, xs: p[1] * F.pow(xs[0], p[0]) + p[2],
}


def _dot(p, xs: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for i, x in enumerate(xs):
        out = out + p[i] * x
    return out


class _Array:
    """Parameters of an array column by place."""

    def __init__(self, column: Column):
        self.column = column

    def __getitem__(self, i: int) -> Column:
        return F.get(self.column, F.lit(i))


def n_parameters(kind: str, n_inputs: int) -> int:
    return n_inputs + (2 if kind.endswith("offset") else 1)


def predict(kind: str, parameters: Column, inputs: Sequence[Column]) -> Column:
    return CURVES[kind](_Array(parameters), list(inputs))


def _gradient(kind: str, p: list[Column], xs: Sequence[Column]) -> list[Column]:
    """Derivatives of a curve by its parameters."""
    if kind == "linear":
        return [*xs, F.lit(1.0)]
    if kind.startswith("power"):
        raised = F.pow(xs[0], p[0])
        out = [p[1] * raised * F.ln(xs[0]), raised]
        return [*out, F.lit(1.0)] if kind == "power_offset" else out
    e = F.exp(_dot(p, xs))
    out = [p[len(xs)] * x * e for x in xs] + [e]
    return out + [F.lit(1.0)] if kind == "exponential_offset" else out


def _solve_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of many small systems; NaN where there is none."""
    try:
        return np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:
        out = np.full(b.shape, np.nan)
        for i in range(len(b)):
            try:
                out[i] = np.linalg.solve(a[i], b[i])
            except np.linalg.LinAlgError:
                pass
        return out


def _straight(df: DataFrame, group: str, inputs: Sequence[str], target: str) -> DataFrame:
    """``(group, parameters)`` of least-squares lines from centred sums in one aggregate, solved in executors; null where the inputs do not determine one."""
    xs, y, n = [F.col(x).cast("double") for x in inputs], F.col(target).cast("double"), len(inputs)
    whole = y.isNotNull()
    for x in xs:
        whole = whole & x.isNotNull()
    of = lambda x: F.when(whole, x)
    mean = F.array(*[F.avg(of(x)) for x in xs], F.avg(of(y)))
    cov = F.array(*[F.covar_pop(of(a), of(b)) for a in xs for b in [*xs, y]])
    sums = df.where(F.col(group).isNotNull()).groupBy(group).agg(mean.alias("m"), cov.alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = lambda name, k: np.array([[np.nan if v is None else v for v in r] for r in b.column(name).to_pylist()], float).reshape(-1, k)  # noqa: B023, E731
            m, c = value("m", n + 1), value("c", n * (n + 1)).reshape(-1, n, n + 1)
            slopes = _solve_rows(c[:, :, :n], c[:, :, n])
            p = np.concatenate((slopes, (m[:, n] - (slopes * m[:, :n]).sum(1))[:, None]), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(group), pa.array([r.tolist() if np.isfinite(r).all() else None for r in p], pa.list_(pa.float64()))], names=[group, "parameters"])

    return sums.mapInArrow(run, T.StructType([df.schema[group], T.StructField("parameters", T.ArrayType(T.DoubleType()))]))


def fit_table(df: DataFrame, group: str, inputs: Sequence[str], target: str, kind: str = "linear", loss: str = "linear", start: DataFrame | None = None, steps: int = 40, positive_offset: bool = False, share: float | None = None) -> DataFrame:
    """``(group, parameters)`` of every group, null where a fit does not converge; no parameters pass the driver, whatever the number of groups.

    A straight line without a loss of its own is solved from one aggregate; ``log_linear`` and ``exp_fit_linear`` are lines
    through ``log(max(target, 1e-6))``. The others, and any with the loss ``huber``, take Levenberg-Marquardt steps for all groups
    together: the parameters are a table that is joined, each step is one grouped aggregate of J'WJ, J'Wr and the cost, and the small
    systems are solved where their rows are. Groups that are done are left out of later steps. ``huber`` weighs a squared residual above 1
    by its inverse root. Each curve starts from a simpler one: exponential from the log-linear fit, with an offset
    from that without, power from the line through logarithms. Power curves need inputs above 0. ``start(group, parameters)`` overrides that.
    ``share`` fits a sample of rows. Null groups are left out.
    """
    n, xs = n_parameters(kind, len(inputs)), [F.col(x).cast("double") for x in inputs]
    df = df.where(F.col(group).isNotNull())
    df = df if share is None else df.sample(share, seed=17)
    nested = lambda k, t=target, rows=df, x=inputs: fit_table(rows, group, x, t, k, loss)
    logs = lambda: df.withColumn("_t", F.ln(F.greatest(F.col(target), F.lit(1e-6))))
    changed = lambda table, e: table.withColumn("parameters", F.when(F.col("parameters").isNotNull(), e))
    last = F.element_at("parameters", -1)
    head = F.slice("parameters", F.lit(1), F.greatest(F.size("parameters") - 1, F.lit(0)))
    if kind in ("log_linear", "exp_fit_linear"):
        line = nested("linear", "_t", logs())
        return line if kind == "log_linear" else changed(line, F.concat(head, F.array(F.exp(last))))
    if kind == "linear" and loss == "linear" and start is None:
        return _straight(df, group, inputs, target)
    if start is None and kind == "power":
        positive = logs().where(F.col(inputs[0]) > 0).withColumn("_x", F.ln(F.col(inputs[0])))
        start = changed(_straight(positive, group, ["_x"], "_t"), F.concat(head, F.array(F.exp(last))))
    elif start is None and kind == "exponential":
        start = changed(_straight(logs(), group, inputs, "_t"), F.concat(head, F.array(F.exp(last))))
    elif start is None and kind.endswith("_offset"):
        start = changed(nested(kind.removesuffix("_offset")), F.concat("parameters", F.array(F.lit(0.0))))
    elif start is None:
        start = df.select(group).distinct().withColumn("parameters", F.array(*[F.lit(0.0)] * n))
    state_type = T.StructType([df.schema[group], *[T.StructField(x, T.ArrayType(T.DoubleType())) for x in ("now", "trial", "a", "b")], *[T.StructField(x, T.DoubleType()) for x in ("cost", "damp")], T.StructField("done", T.BooleanType())])
    nothing = F.lit(None).cast("array<double>")
    state = start.select(group, nothing.alias("now"), F.col("parameters").alias("trial"), nothing.alias("a"), nothing.alias("b"), F.lit(None).cast("double").alias("cost"), F.lit(1e-3).alias("damp"), F.col("parameters").isNull().alias("done"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["done"]:
                    continue
                ok = r["new_cost"] is not None and math.isfinite(r["new_cost"])
                if ok and (r["cost"] is None or r["new_cost"] <= r["cost"]):
                    small = r["cost"] is not None and r["cost"] - r["new_cost"] <= 1e-12 * max(r["cost"], 1e-12)
                    r["now"], r["a"], r["b"], r["cost"], r["damp"] = r["trial"], r["new_a"], r["new_b"], r["new_cost"], r["damp"] / 5
                    r["done"] = small or r["cost"] < 1e-20
                else:
                    r["damp"] *= 7
                    r["done"] = r["now"] is None or r["damp"] > 1e12
            open_ = [r for r in rows if not r["done"]]
            if open_:
                a, b = np.array([r["a"] for r in open_], float).reshape(-1, n, n), np.array([r["b"] for r in open_], float)
                rise = np.array([r["damp"] for r in open_])[:, None] * np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-12)
                trial = np.array([r["now"] for r in open_], float) - _solve_rows(a + rise[:, :, None] * np.eye(n), b)
                for r, t in zip(open_, trial):
                    if np.isfinite(t).all():
                        r["trial"] = t.tolist()
                    else:
                        r["damp"] *= 7
                    if positive_offset and kind == "exponential_offset":
                        r["trial"][-1] = max(r["trial"][-1], 0.0)
            columns = [[r[c] for r in rows] for c in state_type.names[1:]]
            kinds = [*[pa.list_(pa.float64())] * 4, pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(group), *[pa.array(v, k) for v, k in zip(columns, kinds)]], names=state_type.names)

    p = [F.get("trial", F.lit(i)) for i in range(n)]
    for _ in range(steps):
        state = durable(state, "fit-state")
        open_ = state.where(~F.col("done"))
        if open_.isEmpty():
            break
        r = CURVES[kind](p, xs) - F.col(target)
        w = F.when(r * r <= 1, F.lit(1.0)).otherwise(1 / F.abs(r)) if loss == "huber" else F.lit(1.0)
        rho = F.when(r * r <= 1, r * r).otherwise(2 * F.abs(r) - 1) if loss == "huber" else r * r
        rows = df.join(open_.select(F.col(group).alias("_group"), "trial"), F.col(group) == F.col("_group")).select(group, *[g.alias(f"j{i}") for i, g in enumerate(_gradient(kind, p, xs))], r.alias("r"), w.alias("w"), rho.alias("rho"))
        product = lambda i, k: F.sum(F.col("w") * F.col(f"j{i}") * F.col(f"j{k}"))
        sums = rows.groupBy(F.col(group).alias("_group")).agg(F.array(*[product(min(i, k), max(i, k)) for i in range(n) for k in range(n)]).alias("new_a"), F.array(*[F.sum(F.col("w") * F.col(f"j{i}") * F.col("r")) for i in range(n)]).alias("new_b"), (F.sum("rho") / 2).alias("new_cost"))
        state = state.join(sums, F.col(group) == F.col("_group"), "left").drop("_group").mapInArrow(step, state_type)
    return durable(state, "fit").select(group, F.col("now").alias("parameters"))


def fit(df: DataFrame, group: str, inputs: Sequence[str], target: str, kind: str = "linear", loss: str = "linear", start: dict | None = None, steps: int = 40, positive_offset: bool = False, most_groups: int = 100_000) -> dict:
    """:func:`fit_table` as a dictionary, for a few groups: more than ``most_groups`` raise ``ValueError``."""
    begin = None if start is None else df.sparkSession.createDataFrame([(g, None if p is None else [float(v) for v in p]) for g, p in start.items()], T.StructType([df.schema[group], T.StructField("parameters", T.ArrayType(T.DoubleType()))]))
    found = fit_table(df, group, inputs, target, kind, loss, begin, steps, positive_offset).limit(most_groups + 1).collect()
    if len(found) > most_groups:
        raise ValueError(f"over {most_groups} groups to fit")
    return {r[0]: r["parameters"] for r in found}


def save_models(models: DataFrame, path: str) -> None:
    """Write model tables as Parquet, one folder per kind; a kind that is there is replaced as a whole."""
    models.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(path)


def load_models(spark, path: str, kind: str | None = None) -> DataFrame:
    """Saved models, those of one kind if given."""
    found = spark.read.parquet(path)
    return found if kind is None else found.where(F.col("kind") == kind)


def z_training_set(labels: DataFrame, intensity: DataFrame, correlation: DataFrame, distances: DataFrame, keys: Sequence[str] = ("roi", "object", "label"), bounds: Sequence = (), least_r: float = 0.9) -> DataFrame:
    """Rows to fit z-decay on: objects within ``bounds`` with the paths their light takes, and one row per channel.

    ``labels(keys, Centroid-z, DistanceAlongZ, …)`` give ``EmbryoPath``, the distance along z,
    and ``MediumPath``, what is left of the centroid's z. Tall ``intensity(keys,
    acquisition, …)`` and ``distances(keys, …)`` are joined, and ``correlation(keys,
    acquisition, PearsonR)``, which is 1 where missing; rows below ``least_r`` go.
    """
    from tissuemill.operators import clean

    kept = clean.drop_outliers(labels, bounds).withColumns({"EmbryoPath": F.col("DistanceAlongZ"), "MediumPath": F.col("`Centroid-z`") - F.col("DistanceAlongZ")})
    on = list(keys)
    out = kept.join(intensity, on, "left").join(correlation, [*on, "acquisition"], "left").join(distances, on, "left")
    return out.withColumn("PearsonR", F.coalesce("PearsonR", F.lit(1.0))).where(F.col("PearsonR") >= least_r)


def t_training_set(intensity: DataFrame, labels: DataFrame, alignment: DataFrame, times: DataFrame, meta: DataFrame, keys: Sequence[str] = ("roi", "object", "label"), radius: tuple[float, float] = (4.0, 8.0), least_cycle: int = 9, least_score: float = 0.85) -> DataFrame:
    """Means per roi, channel and time to fit t-decay on, with their z-scores per channel, per channel and cycle, and over that group's mean.

    Objects of a size within ``radius``, of rois past ``least_cycle`` in wells that are
    no controls, aligned above ``least_score``.
    """
    from tissuemill.operators import windows

    on = list(keys)
    rows = intensity.join(labels.where(F.col("EquivalentSphericalRadius").between(*radius)).select(*on), on).join(alignment, [*on, "acquisition"])
    rows = rows.join(times, ["roi", "acquisition"]).join(meta.where((F.col("cycle") > least_cycle) & ~F.col("is_control_well")).select("roi", "cycle"), "roi")
    mean = rows.where(F.col("alignmentScore") > least_score).groupBy("roi", "channel", "minutes", "cycle").agg(F.avg("Mean").alias("Mean"))
    mean = windows.z_scored(mean, "Mean", ["channel"], "Mean_ZScore")
    mean = windows.z_scored(mean, "Mean", ["channel", "cycle"], "Mean_CycleZScore")
    return windows.mean_normalised(mean, "Mean", ["channel", "cycle"], "Mean_CycleMeanNorm")


def t_factors(times: DataFrame, models: DataFrame, kind: str) -> DataFrame:
    """``times(roi, channel, minutes)`` with the correction ``factor`` of their channel's model, null where it has none."""
    joined = times.join(models.select("channel", "parameters"), "channel", "left")
    return joined.select("roi", "channel", "minutes", correction_factor(kind, F.col("parameters"), [F.col("minutes").cast("double")]).alias("factor"))


def model_table(spark, models: dict, kind: str, key: str = "channel"):
    """Parameters as a table ``(key, kind, parameters)``, which Parquet persists."""
    return spark.createDataFrame([(g, kind, p) for g, p in models.items()], f"{key} string, kind string, parameters array<double>")


def correction_factor(kind: str, parameters: Column, inputs: Sequence[Column]) -> Column:
    """Value at input 0 over the prediction."""
    return predict(kind, parameters, [F.lit(0.0)] * len(inputs)) / predict(kind, parameters, inputs)


def corrected(df: DataFrame, models: DataFrame, kind: str, inputs: Sequence[str], value: str, key: str = "channel", clip: tuple[float, float] | None = None) -> DataFrame:
    """``value`` times the correction factor; factors outside ``clip``, below too, become its upper bound. Unmatched keys stay as they are."""
    f = correction_factor(kind, F.col("parameters"), [F.col(x).cast("double") for x in inputs])
    if clip:
        f = F.when(f.between(*clip), f).otherwise(F.when(f.isNotNull(), F.lit(float(clip[1]))))
    kind_of = df.schema[value].dataType
    return df.join(models.select(key, "parameters"), key, "left").withColumn(value, (F.col(value) * F.coalesce(f, F.lit(1.0))).cast(kind_of)).select(*df.columns)


def corrected_by_paths(image: DataFrame, mask: DataFrame, models: DataFrame, kind: str, clip: tuple[float, float] | None = (0.0, 50.0), spacing: float = 1.0, first: int = 0, key: str = "c") -> DataFrame:
    """``image(roi, c, z, y, x, value)`` corrected by models of two inputs: the ways of light outside and inside a mask, from place ``first`` along z to each voxel (:func:`lines.with_paths`)."""
    out = corrected(lines.with_paths(image, mask, "z", spacing, first), models, kind, ["MediumPath", "EmbryoPath"], "value", key, clip)
    return out.select(*[F.col(f"`{x}`") for x in image.columns])


def apply_t_factors(image: DataFrame, factors: DataFrame, keys: Sequence[str] = ("roi", "channel")) -> DataFrame:
    """Values times the factor of their roi and channel, 1 if none, type kept."""
    kind = image.schema["value"].dataType
    return image.join(factors.select(*keys, "factor"), list(keys), "left").withColumn("value", (F.col("value") * F.coalesce("factor", F.lit(1.0))).cast(kind)).select(*image.columns)


def grid(df: DataFrame, inputs: Sequence[str], n: int = 20) -> DataFrame:
    """``n`` values per input over its range, in every combination."""
    ends = df.agg(*[f(x).cast("double").alias(f"{e}_{x}") for x in inputs for e, f in (("lo", F.min), ("hi", F.max))])
    for x in inputs:
        ends = ends.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(x, F.col(f"lo_{x}") + (F.col(f"hi_{x}") - F.col(f"lo_{x}")) * F.col("_i") / (n - 1)).drop("_i")
    return ends.select(*inputs)
