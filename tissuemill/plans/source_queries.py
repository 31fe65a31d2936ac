"""Registered queries of sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuemill.functions.durable import shared_dir
from tissuemill.plans.registry import register, table
from tissuemill.sources import tables


def folder(spark: SparkSession) -> str:
    """A new folder of the shared one."""
    return f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines per supplier's nation (roi) and flag (object), as fragments hold them."""
    t, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    rows = t.join(s, t["l_suppkey"] == s["s_suppkey"])
    return rows.select(F.format_string("n%02d", "s_nationkey").alias("roi"), F.col("l_returnflag").alias("object"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


LINES = "(SELECT 'n' || lpad(s_nationkey::VARCHAR, 2, '0') AS roi, l_returnflag AS object, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


@register("s01_read_tables", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def read_tables(spark, d):
    root = folder(spark)
    for name in ("customer", "nation", "region"):
        table(spark, d, name).write.parquet(f"{root}/{name}.parquet")
    found = tables.read_tables(spark, root, ["customer", "nation"])
    return found["customer"].join(found["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@register("s02_read_container", "SELECT s_suppkey::INT AS key, s_name AS name, s_acctbal::FLOAT AS balance FROM supplier")
def read_container(spark, d):
    """A written container cast to its schemas; a declared table that is absent is empty."""
    root = folder(spark)
    tables.write_container({"wells": table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))}, root, "Resources")
    schema = "key int, name string, balance float"
    found = tables.read_container(spark, root, "Resources", {"wells": schema, "rois": schema})
    return found["wells"].unionByName(found["rois"])


@register("s03_write_container", "SELECT 'customer' AS name, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'orders', (SELECT count(*) FROM orders)")
def write_container(spark, d):
    """Which tables of a container are written: empty ones are not."""
    root = folder(spark)
    given = {"customer": table(spark, d, "customer"), "orders": table(spark, d, "orders"), "none": table(spark, d, "nation").where("n_nationkey < 0")}
    tables.write_container(given, root, "Resources")
    out = None
    for stem in tables.stems(spark, root):
        row = spark.read.parquet(f"{root}/{stem}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(stem.removeprefix("Resources.")).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out


@register("s04_read_fragments", f"SELECT roi, object, l_orderkey, l_linenumber, l_partkey, l_quantity FROM {LINES}")
def read_fragments(spark, d):
    root = folder(spark)
    tables.write_fragments(lines(spark, d), root)
    return tables.read_fragments(spark, root)


@register("s05_compact", f"SELECT roi, object, l_orderkey::INT AS l_orderkey, l_linenumber, l_partkey, l_quantity FROM {LINES}")
def compact(spark, d):
    root = folder(spark)
    tables.write_fragments(lines(spark, d), root)
    tables.compact(spark, root, f"{root}.compact", {"l_orderkey": "int"})
    return spark.read.parquet(f"{root}.compact").select("roi", "object", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@register("s06_scan_features", """WITH a AS (SELECT c_custkey AS label, c_mktsegment AS annotation FROM customer), p AS (SELECT o_custkey AS label, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS debris_proba FROM orders GROUP BY 1)
SELECT 'n' || c_nationkey AS roi, c_custkey AS label, c_acctbal AS value, annotation, debris_proba, n_name FROM customer c JOIN a ON c.c_custkey = a.label JOIN p ON c.c_custkey = p.label LEFT JOIN nation ON c_nationkey = n_nationkey WHERE debris_proba < 0.3""")
def scan_features(spark, d):
    c = table(spark, d, "customer")
    features = c.select(F.concat(F.lit("n"), "c_nationkey").alias("roi"), F.col("c_custkey").alias("label"), F.col("c_acctbal").alias("value"))
    annotations = c.select(F.col("c_custkey").cast("int").alias("label"), F.col("c_mktsegment").alias("annotation"))
    predictions = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("label")).agg(F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0)), 6).alias("debris_proba"))
    meta = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("roi"), "n_name")
    return tables.scan_features(features, ["label"], annotations, predictions, meta=meta).select("roi", "label", "value", "annotation", "debris_proba", "n_name")


@register("s07_scan_resources", "SELECT s_suppkey AS key, s_name AS name FROM supplier")
def scan_resources(spark, d):
    root = folder(spark)
    table(spark, d, "supplier").write.parquet(f"{root}/wells.parquet")
    return tables.scan_resources(spark, root, ["wells"], {"s_suppkey": "key", "s_name": "name", "absent": "x"})["wells"].select("key", "name")


@register("s08_write_merged", "SELECT coalesce(c_custkey, o_custkey) AS key, c_name AS name, p AS balance FROM customer FULL JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS p FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) ON c_custkey = o_custkey")
def write_merged(spark, d):
    """A column that is new replaces the old one; the rest is joined on the key."""
    path = f"{folder(spark)}/merged.parquet"
    tables.write_merged(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), path, ["key"])
    new = table(spark, d, "orders").where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("key")).agg(F.round(F.max("o_totalprice"), 2).alias("balance"))
    tables.write_merged(new, path, ["key"], "merge")
    return spark.read.parquet(path).select("key", "name", "balance")


@register("s09_read_annotations", f"SELECT roi, object, l_orderkey AS label, l_quantity AS value FROM {LINES}")
def read_annotations(spark, d):
    root = folder(spark)
    rows = lines(spark, d).select("roi", "object", F.col("l_orderkey").alias("label"), F.col("l_quantity").alias("value"))
    tables.write_fragments(rows, root, "{roi}_{object}_annotation.csv", "csv")
    return tables.read_annotations(spark, f"{root}/*", "label long, value double")


@register("s09_read_features", f"SELECT roi AS filename_prefix, object AS structure, l_orderkey AS label, l_quantity AS value FROM {LINES}")
def read_features(spark, d):
    root = folder(spark)
    rows = lines(spark, d).select("roi", "object", F.col("l_orderkey").alias("label"), F.col("l_quantity").alias("value"))
    tables.write_fragments(rows, root, "{roi}__{object}.csv", "csv")
    return tables.read_features(spark, root, "label long, value double")


@register("s10_read_acquisitions", """WITH m AS (SELECT chr((65 + o_custkey % 8)::INT) || lpad((1 + o_custkey % 12)::VARCHAR, 2, '0') AS well, o_custkey % 400 - 200 AS x, o_orderkey % 3 AS y, 1 + o_orderkey % 4 AS channel, o_orderdate AS t, o_orderstatus = 'F' AS late FROM orders),
k AS (SELECT *, max(late::INT) OVER (PARTITION BY well, x, y) AS last FROM m)
SELECT well, 'px' || CASE WHEN x < 0 THEN '-' ELSE '+' END || lpad(abs(x)::VARCHAR, 4, '0') || '_py+' || lpad(y::VARCHAR, 4, '0') AS site, channel::INT AS channel, t AS time, late::INT AS priority FROM k WHERE late::INT = last""")
def read_acquisitions(spark, d):
    """Measurement records of two folders; where the later one has a site, it replaces all of it."""
    root, o = folder(spark), table(spark, d, "orders")
    rows = o.select((1 + F.col("o_custkey") % 8).alias("_Row"), (1 + F.col("o_custkey") % 12).alias("_Column"), (F.col("o_custkey") % 400 - 200 + 0.2).alias("_X"), (F.col("o_orderkey") % 3 + 0.2).alias("_Y"),
                    (1 + F.col("o_orderkey") % 4).alias("_Ch"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("_Time"), F.col("o_orderstatus").alias("kind"))
    for late in (False, True):
        part = rows.where((F.col("kind") == "F") == F.lit(late))
        part.write.format("xml").option("rowTag", "MeasurementRecord").option("rootTag", "MeasurementData").save(f"{root}/{int(late)}")
    return tables.read_acquisitions(spark, [f"{root}/0", f"{root}/1"])


@register("s11_acquisition_minutes", "SELECT event_id, round(epoch_us(ts) / 6e7 - min(epoch_us(ts)) OVER (PARTITION BY user_id % 5) / 6e7, 4) AS minutes, event_type AS channel_name FROM events QUALIFY event_type = 'click'")
def minutes(spark, d):
    """Users' clicks since the first event of their round."""
    kinds = F.when(F.col("event_type") == "click", 1).otherwise(2)
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("acquisition"), F.col("ts").cast("timestamp").alias("time"), kinds.alias("channel"), F.col("event_type").alias("channel_name"))
    return tables.acquisition_minutes(e).select("event_id", F.round("minutes", 4).alias("minutes"), "channel_name")


@register("s12_write_batches", "SELECT roi, object, l_orderkey, l_linenumber, l_partkey, l_quantity FROM " + LINES)
def write_batches(spark, d):
    """Batches that are there are not written again."""
    path, rows = folder(spark), lines(spark, d)
    tables.write_batches(rows.where("object = 'A'"), path, ["roi", "object"])
    tables.write_batches(rows, path, ["roi", "object"])
    return spark.read.parquet(path).select("roi", "object", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@register("c08_containers", "SELECT c_custkey AS key, c_acctbal AS bal FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def containers(spark, d):
    """Filter the tables that have the column, choose two and put them together."""
    given = {"c": table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal")), "s": table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal")), "n": table(spark, d, "nation")}
    return tables.reduced(tables.select(tables.filter_tables(given, "bal > 0"), "c", "s"), lambda a, b: a.unionByName(b))


@register("c10_selection", """WITH r AS (SELECT o_custkey AS roi, o_orderstatus AS object, o_orderkey AS label FROM orders), k AS (SELECT roi FROM (SELECT roi, row_number() OVER (ORDER BY roi) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT roi FROM r)) WHERE i IN (1, 3) OR i = n)
SELECT * FROM r WHERE roi IN (SELECT roi FROM k) AND object IN ('F', 'O') AND NOT (object = 'O' AND object IS NOT NULL AND label % 2 = 0)""")
def selection(spark, d):
    """The first, third and last customer's orders, by state, without even open ones."""
    o = table(spark, d, "orders")
    by_state = {s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("roi"), F.col("o_orderkey").alias("label")) for s in ("F", "O", "P")}
    rows = tables.isel(tables.roi_table(by_state), roi=[0, 2, -1])
    return tables.drop_sel(tables.sel(rows, object=["F", "O"]).withColumn("even", F.concat_ws("", "object", F.col("label") % 2)), even="O0").select("roi", "object", "label")


@register("s10_read_channels", "SELECT DISTINCT (1 + o_orderkey % 4)::INT AS channel, (400 + 50 * (o_orderkey % 4))::INT AS wavelength, o_orderpriority AS stain FROM orders")
def read_channels(spark, d):
    """A channel map in XML, repeated entries once."""
    root, o = folder(spark), table(spark, d, "orders")
    rows = o.select((1 + F.col("o_orderkey") % 4).alias("_Ch"), (400 + 50 * (F.col("o_orderkey") % 4)).alias("_Wavelength"), F.col("o_orderpriority").alias("_Fluorophore"))
    rows.write.format("xml").option("rowTag", "MeasurementChannel").option("rootTag", "MeasurementSetting").save(f"{root}/setting")
    return tables.read_channels(spark, f"{root}/setting")


@register("x05_pipe", "SELECT 'c' AS which, count(*) AS n, round(sum(c_acctbal) * 2, 2) AS total FROM customer UNION ALL SELECT 's', count(*), round(sum(s_acctbal), 2) FROM supplier")
def pipe(spark, d):
    """A function applied to the tables of a container but one, then one column of each taken."""
    given = {"c": table(spark, d, "customer").select(F.col("c_acctbal").alias("bal")), "s": table(spark, d, "supplier").select(F.col("s_acctbal").alias("bal"))}
    piped = tables.pipe(given, lambda t: t.withColumn("bal", 2 * F.col("bal")), exclude=["s"])
    one = lambda k: tables.take(piped, k, "bal").agg(F.lit(k).alias("which"), F.count(F.lit(1)).alias("n"), F.round(F.sum("bal"), 2).alias("total"))
    return one("c").union(one("s"))
