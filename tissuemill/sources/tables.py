"""Reading, writing and compacting collections of measurement tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuemill.functions.durable import durable


def _fs(spark: SparkSession, path: str):
    """Hadoop file system and path object, so that any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def stems(spark: SparkSession, root: str) -> list[str]:
    """Names of the Parquet tables directly under a folder."""
    fs, p = _fs(spark, root)
    return sorted(s.getPath().getName()[:-8] for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))


def read_tables(spark: SparkSession, root: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """``{stem: frame}`` of a folder's Parquet tables, or of those named; an unknown name is an error."""
    found = stems(spark, root)
    wanted = found if names is None else list(names)
    if missing := [n for n in wanted if n not in found]:
        raise FileNotFoundError(f"no tables {missing} in {root}")
    return {n: spark.read.parquet(f"{root}/{n}.parquet") for n in wanted}


def read_container(spark: SparkSession, root: str, prefix: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables ``{prefix}.{table}.parquet`` cast to their declared schemas; absent ones are empty, undeclared ones an error."""
    present = {s.removeprefix(f"{prefix}.") for s in stems(spark, root) if s.startswith(f"{prefix}.")}
    if unknown := present - set(schemas):
        raise ValueError(f"tables without a schema: {sorted(unknown)}")
    out = {}
    for name, schema in schemas.items():
        empty = spark.createDataFrame([], schema)
        if name in present:
            df = spark.read.parquet(f"{root}/{prefix}.{name}.parquet")
            out[name] = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in empty.schema.fields])
        else:
            out[name] = empty
    return out


def write_container(tables: dict[str, DataFrame], root: str, prefix: str, overwrite: bool = False, write_empty: bool = False) -> None:
    """Write each table unless it is empty; if any target is there and ``overwrite`` is not set, write nothing and fail."""
    for name, df in tables.items():
        if not overwrite and exists(df.sparkSession, f"{root}/{prefix}.{name}.parquet"):
            raise FileExistsError(f"{root}/{prefix}.{name}.parquet")
    for name, df in tables.items():
        if write_empty or not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{root}/{prefix}.{name}.parquet")


def read_fragments(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """Many small files ``root/{roi}/{object}….parquet`` as one table: union by name, with ``roi`` and ``object`` from the path first."""
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(root)
    path = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("roi"), F.regexp_extract(path, r"([^/]+)\.parquet$", 1).alias("object"), *[F.col(f"`{c}`") for c in df.columns])


def compact(spark: SparkSession, root: str, target: str, casts: dict[str, str] | None = None, rows_per_file: int = 5_000_000) -> None:
    """Fragments as one table per object under ``target``, in files of a bounded number of rows."""
    df = read_fragments(spark, root)
    df = df.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in (casts or {}).items() if c in df.columns})
    # one shuffle by object, whose large partitions are split and small ones put together as they come out
    df.hint("rebalance", "object").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("object").parquet(target)


def scan_features(features: DataFrame, keys: list[str], annotations: DataFrame | None = None, predictions: DataFrame | None = None, keep: str = "debris_proba < 0.3", meta: DataFrame | None = None) -> DataFrame:
    """Features with annotations and predictions joined on the keys, whose types are aligned, and filtered; ``meta(roi, …)`` is joined if given."""
    out = features
    for extra in (annotations, predictions):
        if extra is not None:
            cast = extra.withColumns({k: F.col(k).cast(features.schema[k].dataType) for k in keys})
            out = out.join(cast, keys, "left")
    out = out.where(keep) if keep else out
    return out if meta is None else out.join(meta, "roi", "left")


def scan_container(tables: dict[str, DataFrame], on: str, keys: list[str], annotations: dict[str, DataFrame] | None = None, predictions: list[DataFrame] | None = None, keep: str | None = "debris_proba < 0.3", control_wells: Iterable[str] = (), meta_on: Iterable[str] = ()) -> dict[str, DataFrame]:
    """A container with annotations and predictions joined to the table ``on``, which is then filtered, and ``meta``, derived from its rois and parents.

    ``annotations`` go by the name that their column ``annotation`` takes. ``meta`` is :func:`aggregate.roi_metadata` of
    the filtered table's ``(roi, parent)`` and is joined to the tables ``meta_on``. Keys take the types of the table they are joined to.
    """
    from tissuemill.operators.aggregate import roi_metadata

    out, rows = dict(tables), tables[on]
    extras = [t.withColumnRenamed("annotation", n) for n, t in (annotations or {}).items()] + list(predictions or [])
    for extra in extras:
        rows = rows.join(extra.withColumns({k: F.col(k).cast(rows.schema[k].dataType) for k in keys}), keys, "left")
    out[on] = rows.where(keep) if keep else rows
    out["meta"] = durable(roi_metadata(out[on].select("roi", "parent"), list(control_wells)).drop("parent"), "scan-meta")
    for name in meta_on:
        out[name] = out[name].join(out["meta"], "roi")
    return out


def scan_resources(spark: SparkSession, root: str, names: Iterable[str], renames: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of a folder with columns renamed where they are there."""
    return {n: t.withColumnsRenamed({a: b for a, b in renames.items() if a in t.columns}) for n, t in read_tables(spark, root, names).items()}


def write_fragments(df: DataFrame, root: str, name: str = "{object}.parquet", form: str = "parquet") -> None:
    """Write ``df(roi, object, …)`` as one file per roi and object, ``root/{roi}/{name}``; the driver renames the files."""
    spark, staged = df.sparkSession, f"{root}.staged-{uuid.uuid4().hex}"
    df.repartition("roi", "object").write.format(form).option("header", True).partitionBy("roi", "object").save(staged)
    fs, top = _fs(spark, staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for s in fs.globStatus(path(f"{staged}/roi=*/object=*/part-*")):
        roi, obj = (s.getPath().getParent().getParent().getName()[4:], s.getPath().getParent().getName()[7:])
        fs.mkdirs(path(f"{root}/{roi}"))
        fs.rename(s.getPath(), path(f"{root}/{roi}/{name.format(roi=roi, object=obj)}"))
    fs.delete(top, True)


def write_merged(df: DataFrame, path: str, keys: list[str], strategy: str = "raise") -> None:
    """Write a table where one may be: ``raise``, ``overwrite``, or ``merge`` — old columns that are also new are dropped, the rest joined on the keys.

    A merge goes to a staging folder; the old table is renamed aside, the new one takes
    its place, and only then is the old one deleted, so one of them is always there.
    """
    spark = df.sparkSession
    if not exists(spark, path) or strategy == "overwrite":
        df.write.mode("overwrite").parquet(path)
        return
    if strategy != "merge":
        raise FileExistsError(path)
    old = spark.read.parquet(path)
    merged = old.select(*[f"`{c}`" for c in old.columns if c in keys or c not in df.columns]).join(df, keys, "full")
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    fs, p = _fs(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    fs.rename(p, aside)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), p)
    fs.delete(aside, True)


def read_annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV annotations with ``roi`` and ``object`` parsed from names like ``{roi}_{object}_annotation.csv``."""
    name = F.col("_metadata.file_name")
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(F.regexp_extract(name, r"^(.*)_([^_]+)_annotation\.csv$", 1).alias("roi"), F.regexp_extract(name, r"^(.*)_([^_]+)_annotation\.csv$", 2).alias("object"), *df.columns)


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV features of a folder as one table, with ``filename_prefix`` and ``structure`` from names like ``{prefix}__{structure}.csv``."""
    name = F.col("_metadata.file_name")
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    return df.select(F.regexp_extract(name, r"^(.*)__([^_.]+)\.csv$", 1).alias("filename_prefix"), F.regexp_extract(name, r"^(.*)__([^_.]+)\.csv$", 2).alias("structure"), *[F.col(f"`{c}`") for c in df.columns])


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """Channel map ``(channel, wavelength, stain)`` of a measurement description in XML."""
    df = spark.read.format("xml").option("rowTag", "MeasurementChannel").option("ignoreNamespace", "true").load(path)
    return df.select(F.col("_Ch").cast("int").alias("channel"), F.col("_Wavelength").cast("int").alias("wavelength"), F.col("_Fluorophore").alias("stain")).distinct()


def read_acquisitions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Measurement records ``(well, site, channel, time, priority)`` of XML folders; a later folder replaces the whole of a site it has."""
    rows = None
    for i, p in enumerate(paths):
        df = spark.read.format("xml").option("rowTag", "MeasurementRecord").option("ignoreNamespace", "true").load(p)
        row = F.format_string("%s%02d", F.expr("char(64 + cast(_Row as int))"), F.col("_Column").cast("int"))
        site = F.format_string("px%+05d_py%+05d", F.round("_X").cast("int"), F.round("_Y").cast("int"))
        part = df.select(row.alias("well"), site.alias("site"), F.col("_Ch").cast("int").alias("channel"), F.to_timestamp("_Time").alias("time"), F.lit(i).alias("priority"))
        rows = part if rows is None else rows.union(part)
    last = rows.groupBy("well", "site").agg(F.max("priority").alias("last"))
    return rows.join(last, ["well", "site"]).where("priority = last").drop("last")


def acquisition_minutes(times: DataFrame) -> DataFrame:
    """Minutes since the earliest acquisition of the round over all channels, for channel 1; minima are joined."""
    first = times.groupBy("acquisition").agg(F.min("time").alias("_first"))
    return times.join(first, "acquisition").withColumn("minutes", (F.unix_micros("time") - F.unix_micros("_first")) / 6e7).where("channel = 1").drop("_first")


def write_batches(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Write one partition per key combination that is not there yet; returns the batches written, as a table of its own, so no key passes the driver."""
    batches = df.select(*keys).distinct()
    if exists(df.sparkSession, path):
        batches = batches.join(df.sparkSession.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    batches = durable(batches, "new-batches")
    if not batches.isEmpty():
        df.join(batches, keys, "left_semi").write.mode("append").partitionBy(*keys).parquet(path)
    return batches


def select(tables: dict[str, DataFrame], *names: str) -> dict[str, DataFrame]:
    """The named tables; an unknown name is an error."""
    return {n: tables[n] for n in names}


def reduced(tables: dict[str, DataFrame], f: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """One table from pairwise steps over all of them, in order."""
    from functools import reduce

    return reduce(f, tables.values())


def take(tables: dict[str, DataFrame], name: str, column: str | None = None) -> DataFrame:
    """One table, or one of its columns."""
    return tables[name] if column is None else tables[name].select(f"`{column}`")


def sel(df: DataFrame, **wanted) -> DataFrame:
    """Rows by coordinate: each column equal to a value or in a list of values."""
    for name, value in wanted.items():
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(name) == value)
    return df


def drop_sel(df: DataFrame, **unwanted) -> DataFrame:
    """Rows that no given coordinate names; a row with a null coordinate stays."""
    for name, value in unwanted.items():
        gone = F.col(name).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(name) == value
        df = df.where(~F.coalesce(gone, F.lit(False)))
    return df


def isel(df: DataFrame, **places: int | list[int]) -> DataFrame:
    """Rows whose coordinate stands at given places of its sorted different values, from 0; negative: from the end."""
    from tissuemill.operators.ranked import values_at

    for name, place in places.items():
        wanted = list(place) if isinstance(place, list | tuple) else [place]
        different = df.select(F.lit(1).alias("_g"), F.col(name)).distinct()
        found = values_at(different, ["_g"], name, {f"p{i}": F.lit(k) if k >= 0 else F.col("all") + k for i, k in enumerate(wanted)})
        chosen = found.select(F.explode(F.array(*[f"p{i}" for i in range(len(wanted))])).alias(name)).where(F.col(name).isNotNull())
        df = df.join(F.broadcast(chosen.distinct()), name, "left_semi")
    return df


def pipe(tables: dict[str, DataFrame], f: Callable[[DataFrame], DataFrame], include: Iterable[str] | None = None, exclude: Iterable[str] = ()) -> dict[str, DataFrame]:
    """Apply a function to chosen tables."""
    chosen = set(tables if include is None else include) - set(exclude)
    return {n: f(t) if n in chosen else t for n, t in tables.items()}


def filter_tables(tables: dict[str, DataFrame], condition: str) -> dict[str, DataFrame]:
    """Filter every table that has the condition's columns; the others pass unchanged."""
    names = set(re.findall(r"`([^`]+)`|\b([A-Za-z_][A-Za-z0-9_]*)\b", condition))
    flat = {a or b for a, b in names}
    columns = {c for t in tables.values() for c in t.columns} & flat
    return {n: t.where(condition) if columns <= set(t.columns) else t for n, t in tables.items()}


def roi_table(tables: dict[str, DataFrame], rois: list[str] | None = None) -> DataFrame:
    """Tables by object as one table with ``object`` first; rows of the chosen rois."""
    out = None
    for name, t in tables.items():
        part = t.select(F.lit(name).alias("object"), *[f"`{c}`" for c in t.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if rois is None else out.where(F.col("roi").isin(rois))
