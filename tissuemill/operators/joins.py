"""Joins of feature and resource tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_all(frames: Sequence[DataFrame], on: Sequence[str], how: str = "full") -> DataFrame:
    """Left-to-right join with coalesced keys."""
    return reduce(lambda a, b: a.join(b, list(on), how), frames)


def repeated_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*[f"`{k}`" for k in on]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def join_on_shared(left: DataFrame, right: DataFrame, keys: Callable[[DataFrame], list[str]], how: str = "full", validate: str = "m:m") -> DataFrame:
    """Join on the key columns that both tables have; ``validate`` as ``1:1``, ``1:m``, ``m:1`` or ``m:m`` checks that the sides marked 1 do not repeat a key."""
    on = [k for k in keys(left) if k in keys(right)]
    for side, df in zip(validate.split(":"), (left, right)):
        if side == "1" and not repeated_keys(df, on).isEmpty():
            raise ValueError(f"keys {on} repeat on a side that should have them once")
    return left.join(right, on, how)


def semi_propagate(tables: dict[str, DataFrame], source: str, on: Sequence[str]) -> dict[str, DataFrame]:
    """Limit every table with the key columns to the keys of ``source``."""
    keys = tables[source].select(*on).distinct()
    return {n: t if n == source or not set(on) <= set(t.columns) else t.join(keys, list(on), "left_semi") for n, t in tables.items()}


def consistent_subset(facts: dict[str, DataFrame], dimensions: dict[str, tuple[DataFrame, str]], how: str = "intersection") -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Dimensions limited to values that facts have (in all of them, or in any), then facts limited to the dimensions.

    ``dimensions`` maps a name to its table and key column, which facts share.
    """
    dims = {}
    for name, (table, key) in dimensions.items():
        sets = [f.select(key).distinct() for f in facts.values() if key in f.columns]
        if not sets:
            dims[name] = table
            continue
        used = reduce(lambda a, b: a.intersect(b) if how == "intersection" else a.union(b).distinct(), sets)
        dims[name] = table.join(used, key, "left_semi")
    out = {}
    for name, fact in facts.items():
        for d, (_, key) in dimensions.items():
            if key in fact.columns:
                fact = fact.join(dims[d].select(key), key, "left_semi")
        out[name] = fact
    return out, dims


def missing_names(requested: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """Requested names that are not there."""
    return requested.select(on).distinct().join(present.select(on), on, "left_anti")


def pair_queries(sites: DataFrame, available: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Every 2-combination of ``channels`` for each site, with whether the site has both, and any and all of that per site.

    ``sites(site)``, ``available(site, channel)``. The product is with a list given by the caller.
    """
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]
    has = available.groupBy("site").agg(F.collect_set("channel").alias("have"))
    rows = sites.select("site", F.explode(F.array(*[F.struct(F.lit(a).alias("c0"), F.lit(b).alias("c1")) for a, b in pairs])).alias("p")).select("site", "p.*")
    rows = rows.join(has, "site", "left").withColumn("valid", F.coalesce(F.array_contains("have", F.col("c0")) & F.array_contains("have", F.col("c1")), F.lit(False))).drop("have")
    per = rows.groupBy("site").agg(F.bool_or("valid").alias("any_valid"), F.bool_and("valid").alias("all_valid"))
    return rows.join(per, "site")


def correlation_queries(sites: DataFrame, images: DataFrame, label_images: DataFrame, levels: Sequence[int], objects: Sequence[str], pairs: Sequence[tuple[str, str]], wells: Sequence[str] | None = None, keep: str = "invalid") -> DataFrame:
    """Every level, object type and channel pair asked of each site, ``(m, roi, o, c0, c1, valid, any_valid, all_valid)``; the lists are the caller's.

    A query is valid if its level has an image of both channels and a label image of the object
    type at that site: ``images(m, roi, c)``, ``label_images(m, roi, o)``. ``any_valid`` and ``all_valid``
    tell of all queries of a level and site. ``keep``: ``invalid`` returns every query, ``any_valid`` the valid ones,
    ``all_valid`` those of levels and sites where all are. ``sites(roi, well)`` are bounded by ``wells`` if given.
    """
    if keep not in ("invalid", "any_valid", "all_valid"):
        raise ValueError(f"no such choice of queries: {keep}")
    asked = sites if wells is None else sites.where(F.col("well").isin(list(wells)))
    each = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    rows = asked.select("roi", each("m", levels)).select("*", each("o", objects)).select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("c0"), F.lit(b).alias("c1")) for a, b in pairs])).alias("p")).select("m", "roi", "o", "p.*")
    have = images.groupBy("m", "roi").agg(F.collect_set("c").alias("_c")).join(label_images.groupBy("m", "roi").agg(F.collect_set("o").alias("_o")), ["m", "roi"])
    valid = F.array_contains("_c", F.col("c0")) & F.array_contains("_c", F.col("c1")) & F.array_contains("_o", F.col("o"))
    rows = rows.join(have, ["m", "roi"], "left").withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_c", "_o")
    out = rows.join(rows.groupBy("m", "roi").agg(F.bool_or("valid").alias("any_valid"), F.bool_and("valid").alias("all_valid")), ["m", "roi"])
    return out if keep == "invalid" else out.where("valid") if keep == "any_valid" else out.where("valid and all_valid")


def merged_key(keys: Sequence[str], sep: str = "__") -> Column:
    """The keys' values as one text; a value that holds the separator is an error, as two rows could then have one key."""
    parts = [F.col(f"`{k}`").cast("string") for k in keys]
    clean = [F.when(F.coalesce(F.contains(x, F.lit(sep)), F.lit(False)), F.raise_error(F.concat(F.lit(f"{k} holds {sep}: "), x))).otherwise(x) for k, x in zip(keys, parts)]
    return F.concat_ws(sep, *clean)


def layers(base: DataFrame, others: dict[str, DataFrame], on: Sequence[str], sep: str = ":") -> DataFrame:
    """Base rows with each other structure's features prefixed; objects without a match get NaN in doubles."""
    out = base
    for name, df in others.items():
        values = [x for x in df.columns if x not in on]
        named = df.select(*on, *[F.col(f"`{v}`").alias(f"{name}{sep}{v}") for v in values])
        out = out.join(named, list(on), "left")
        doubles = [f"{name}{sep}{v}" for v in values if dict(df.dtypes)[v] in ("double", "float")]
        out = out.withColumns({d: F.coalesce(F.col(f"`{d}`"), F.lit(float("nan"))) for d in doubles})
    return out


def image_paths(images: DataFrame, sites: DataFrame, labels: DataFrame, z_models: DataFrame, t_models: DataFrame, channels: Sequence[str], level: int | None = 0,
                masks: Sequence[str | None] | None = None, z_model: str | None = None, t_model: str | None = None) -> DataFrame:
    """One row per site and channel with all the paths it needs: its image, its mask, its models and their mask.

    ``images(m, roi, c, path)``; ``labels(m, roi, o, path, factors)``, one per level, site and object type; ``z_models(c, z_model, o, path)``; ``t_models(c, roi, t_model, factor)``.
    A lookup of one row per channel (its place, its mask's object type, the z-model of that name, or the one without, and that model's object type) is joined
    once, and so are a site's label images, as a map by object type, and its factors, as a map by channel; what is not there is null.
    Model descriptions ``.json`` name their ``.pkl``.
    """
    if masks is not None and len(masks) != len(channels):
        raise ValueError(f"{len(masks)} masks for {len(channels)} channels")
    spark = images.sparkSession
    wanted = spark.createDataFrame([(ch, i, m) for i, (ch, m) in enumerate(zip(channels, masks or [None] * len(channels)))], "c string, channel_order int, mask_o string")
    of = z_models.where(F.col("z_model").eqNullSafe(F.lit(z_model))).select("c", "z_model", F.col("o").alias("z_o"), F.regexp_replace("path", r"\.json$", ".pkl").alias("z_model_path"))
    lookup = wanted.join(of, "c", "left")
    by = lambda t, keys, key, value, name: t.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))
    site_labels = by(labels, ["m", "roi"], F.col("o"), F.struct("path", "factors"), "_labels")
    site_factors = by(t_models.where(F.col("t_model").eqNullSafe(F.lit(t_model))), ["roi"], F.col("c"), F.struct("t_model", "factor"), "_t")
    chosen = images if level is None else images.where(F.col("m") == level)
    rows = chosen.join(F.broadcast(lookup), "c").join(sites, "roi").join(site_labels, ["m", "roi"], "left").join(site_factors, "roi", "left")
    label = lambda p: F.try_element_at("_labels", F.col(f"{p}_o"))
    found = {f"{p}_{x}": label(p)[x] for p in ("mask", "z") for x in ("path", "factors")}
    return rows.withColumns(found | {x: F.try_element_at("_t", F.col("c"))[x] for x in ("t_model", "factor")}).drop("_labels", "_t")


def boxes_with_channels(objects: DataFrame, channels: DataFrame, site: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Objects with a list ``channels`` of ``(c, label)`` in the site's channel order: the label where the channel is isolated, else null.

    ``objects(site, key, label, …)``; ``channels(site, c, channel_order, isolate)``.
    """
    each = channels.groupBy(*site).agg(F.array_sort(F.collect_list(F.struct("channel_order", "c", "isolate"))).alias("_c"))
    rows = objects.join(each, list(site))
    listed = F.transform("_c", lambda x: F.struct(x["c"].alias("c"), F.when(x["isolate"], F.col("label")).alias("label")))
    return rows.withColumn("channels", listed).drop("_c")


def request_rows(requests: DataFrame, channels: Sequence[str], references: Sequence[str] = (), targets: Sequence[str] = ()) -> DataFrame:
    """Extraction requests as one row per thing to compute: ``(family, object, c, c_ref, target, feature)``.

    ``requests(family, object, features array)``: ``label`` and ``density`` give a row per feature,
    ``intensity`` one per channel and feature, ``colocalization`` per pair of a channel and
    another reference, ``distance`` per target other than the object. The lists are the caller's.
    """
    pair = lambda a, b: F.struct(F.lit(a).cast("string").alias("c"), F.lit(b).cast("string").alias("c_ref"))
    single, pairs = F.array(*[pair(x, None) for x in channels]), F.array(*[pair(x, y) for x in channels for y in references if x != y])
    none = F.array(pair(None, None))
    rows = requests.withColumn("p", F.explode(F.when(F.col("family") == "intensity", single).when(F.col("family") == "colocalization", pairs).otherwise(none)))
    goal = F.filter(F.array(*[F.lit(t) for t in targets]).cast("array<string>"), lambda t: t != F.col("object"))
    rows = rows.withColumn("target", F.explode(F.when(F.col("family") == "distance", goal).otherwise(F.array(F.lit(None).cast("string")))))
    return rows.select("family", "object", "p.c", "p.c_ref", "target", F.explode("features").alias("feature"))
