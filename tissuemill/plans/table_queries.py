"""Registered queries on tables: projection, reshaping, joins, aggregation, windows, cleaning.

The driver's tables stand in for feature tables: orders are objects of a type (their
status) under customers and nations, order lines summed per order and flag are tall
features with the flag as channel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tissuemill.functions import names
from tissuemill.operators import aggregate as agg
from tissuemill.operators import clean, joins, reshape, windows
from tissuemill.plans.registry import register, table


def children(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("o"), F.col("o_orderkey").alias("label"), F.col("o_totalprice").alias("price"))


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderstatus").alias("o_child"), F.col("o_orderkey").alias("label_child"), F.lit("nation").alias("o_parent"), F.col("c_nationkey").cast("long").alias("label_parent"))


def tall(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("Sum"), F.max("l_extendedprice").alias("Mean"))


TALL = "(SELECT l_orderkey, l_returnflag, sum(l_quantity) AS \"Sum\", max(l_extendedprice) AS \"Mean\" FROM lineitem GROUP BY ALL)"
JOINED = "(SELECT o.*, c.* FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"


@register("a08_children_to_parents_wide", f"""SELECT 'nation' AS o_parent, c_nationkey::BIGINT AS label_parent, {", ".join(f"""
  nullif(count(*) FILTER (WHERE o_orderstatus = '{s}'), 0) AS n_{s}, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2) AS mean_{s},
  round(max(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2) AS max_{s}, round(quantile_cont(o_totalprice, 0.5) FILTER (WHERE o_orderstatus = '{s}'), 4) AS median_{s}""" for s in "FOP")}
FROM {JOINED} WHERE c_nationkey <> 0 GROUP BY ALL""")
def children_to_parents(spark, d):
    wide = agg.many_to_one_wide(children(spark, d), hierarchy(spark, d), ["price"], [agg.Count, agg.Mean, agg.Max, agg.Median], ["F", "O", "P"])
    return wide.select("o_parent", "label_parent", *[x for s in "FOP" for x in (
        F.col(f"{s}__Count").alias(f"n_{s}"), F.round(f"{s}__price__Mean", 2).alias(f"mean_{s}"), F.round(f"{s}__price__Max", 2).alias(f"max_{s}"), F.round(f"{s}__price__Median", 4).alias(f"median_{s}"))])


@register("a01_to_a07_aggregates", """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(sum(l_quantity), 2) AS sum, min(l_quantity) AS low, max(l_quantity) AS high,
  quantile_cont(l_quantity, 0.5) AS median, list_sort(list(l_extendedprice))[round((count(l_extendedprice) - 1) * 0.25)::INT + 1] AS q25 FROM lineitem GROUP BY 1""")
def aggregates(spark, d):
    rows = table(spark, d, "lineitem")
    x = ["l_quantity"]
    out = rows.groupBy("l_returnflag").agg(*[c for a in (agg.Count, agg.Mean, agg.Sum, agg.Min, agg.Max, agg.Median) for c in a(x)])
    q = agg.quantile_nearest_rows(rows, ["l_returnflag"], "l_extendedprice", [0.25])
    return out.join(q, "l_returnflag").select("l_returnflag", F.col("Count").alias("n"), F.round("l_quantity__Mean", 6).alias("mean"), F.round("l_quantity__Sum", 2).alias("sum"),
                                              F.col("l_quantity__Min").alias("low"), F.col("l_quantity__Max").alias("high"), F.col("l_quantity__Median").alias("median"), F.col("`l_extendedprice__Q(0.25)`").alias("q25"))


@register("a07_quantile_nearest_small_groups", "SELECT o_custkey, list_sort(list(o_totalprice))[round((count(*) - 1) * 0.75)::INT + 1] AS q75 FROM orders GROUP BY 1")
def small_quantiles(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(agg.quantile_nearest(F.col("o_totalprice"), 0.75).alias("q75"))


@register("a09_one_to_one", f"SELECT 'nation' AS o_parent, c_nationkey::BIGINT AS label_parent, o_orderstatus AS o_child, o_totalprice AS price FROM {JOINED} WHERE c_nationkey <> 0")
def one_to_one(spark, d):
    return agg.one_to_one(children(spark, d), hierarchy(spark, d), ["price"])


@register("a10_self_hierarchy", f"""WITH h AS (SELECT o_orderstatus AS o_child, o_orderkey AS label_child, 'nation' AS o_parent, c_nationkey::BIGINT AS label_parent FROM {JOINED})
SELECT * FROM h UNION SELECT o_parent, label_parent, o_parent, label_parent FROM h UNION SELECT o_child, label_child, o_child, label_child FROM h""")
def self_hierarchy(spark, d):
    return agg.with_self(hierarchy(spark, d), True)


@register("a11_aggregate_hierarchy", f"""SELECT 'nation' AS o_parent, c_nationkey::BIGINT AS label_parent, {", ".join(f"round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), NULL), 2) AS sum_{s}" for s in "FOP")}
FROM {JOINED} WHERE c_nationkey <> 0 GROUP BY ALL""")
def whole_hierarchy(spark, d):
    out = agg.aggregate_hierarchy(children(spark, d), hierarchy(spark, d), ["price"], [agg.Sum])
    return out.select("o_parent", "label_parent", *[F.round(f"{s}__price__Sum" if f"{s}__price__Sum" in out.columns else f"{s}_price", 2).alias(f"sum_{s}") for s in "FOP"])


@register("a12_cardinality", f"""WITH h AS (SELECT o_orderstatus AS o_child, o_orderkey AS label_child, 'nation' AS o_parent, c_nationkey AS label_parent FROM {JOINED} WHERE c_nationkey <> 0),
p AS (SELECT o_child, o_parent, max(n) AS c FROM (SELECT o_child, o_parent, label_parent, count(*) AS n FROM h GROUP BY ALL) GROUP BY ALL),
q AS (SELECT o_child, o_parent, max(n) AS p FROM (SELECT o_child, o_parent, label_child, count(*) AS n FROM h GROUP BY ALL) GROUP BY ALL)
SELECT o_child, o_parent, CASE WHEN c > 1 THEN 'm' ELSE '1' END || ':' || CASE WHEN p > 1 THEN 'm' ELSE '1' END AS cardinality FROM p JOIN q USING (o_child, o_parent)""")
def cardinality(spark, d):
    return agg.cardinality(hierarchy(spark, d))


@register("a13_hierarchy_counts", "SELECT o_custkey, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS n_{s}" for s in "FOP") + " FROM orders GROUP BY 1")
def hierarchy_counts(spark, d):
    out = agg.hierarchy_counts(table(spark, d, "orders").withColumn("object", F.col("o_orderstatus")), ["o_custkey"], ["F", "O", "P"])
    return out.select("o_custkey", *[F.coalesce(f"{s}_Count", F.lit(0)).alias(f"n_{s}") for s in "FOP"])


@register("a14_roi_metadata", """WITH n AS (SELECT chr((65 + c_nationkey % 5)::INT) || lpad((1 + c_nationkey % 7)::VARCHAR, 2, '0') || '_px+0000_py+0000' AS roi, c_custkey FROM customer),
m AS (SELECT roi, 1 AS parent, count(*) AS count FROM n GROUP BY 1)
SELECT roi, parent, count, round(log2(count), 6) AS log2, round(log2(count))::INT AS cycle, split_part(roi, '_', 1) AS well, 'px+0000_py+0000' AS site, substr(roi, 1, 1) AS row, substr(split_part(roi, '_', 1), 2) AS col,
  split_part(roi, '_', 1) IN ('A01', 'C03') AS is_control_well, CASE split_part(roi, '_', 1) WHEN 'A01' THEN 0 WHEN 'C03' THEN 1 ELSE 1000 END AS control_position, 'emb_' || (row_number() OVER (ORDER BY roi) - 1) AS embryo FROM m""")
def metadata(spark, d):
    rows = table(spark, d, "customer").select(F.format_string("%s%02d_px+0000_py+0000", F.char(65 + F.col("c_nationkey") % 5), 1 + F.col("c_nationkey") % 7).alias("roi"), F.lit(1).alias("parent"))
    return agg.roi_metadata(rows, ["A01", "C03"]).withColumn("log2", F.round("log2", 6))


@register("a15_pooled_cycle", "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity / 4 <= 9.5 THEN 9 WHEN l_quantity / 4 <= 10.5 THEN 10 WHEN l_quantity / 4 <= 11.5 THEN 11 ELSE 12 END AS cycle FROM lineitem")
def pooled(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", agg.pooled_cycle(F.col("l_quantity") / 4).alias("cycle"))


@register("a16_counts_per_prefix", """WITH n AS (SELECT chr((65 + c_nationkey % 5)::INT) || '02_' || c_nationkey || '_x_s' || c_nationkey % 3 AS prefix FROM customer)
SELECT prefix, count(*) AS cell_count, round(log2(count(*)), 6) AS log2_cell_count, round(log2(count(*)))::INT AS cycle, split_part(prefix, '_', 1) AS well, split_part(prefix, '_', 2) || '_' || split_part(prefix, '_', 4) AS embryo FROM n GROUP BY 1""")
def prefix_counts(spark, d):
    n = F.col("c_nationkey")
    rows = table(spark, d, "customer").select(F.concat(F.char(65 + n % 5), F.lit("02_"), n.cast("string"), F.lit("_x_s"), (n % 3).cast("string")).alias("prefix"))
    return agg.cell_counts(rows, "prefix").withColumn("log2_cell_count", F.round("log2_cell_count", 6))


@register("a17_null_counts", """WITH t AS (SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS b, c_name AS c FROM customer)
SELECT 'a' AS column, count(*) - count(a) AS nulls, round((count(*) - count(a)) / count(*), 6) AS share FROM t UNION ALL SELECT 'b', count(*) - count(b), round((count(*) - count(b)) / count(*), 6) FROM t UNION ALL SELECT 'c', count(*) - count(c), round((count(*) - count(c)) / count(*), 6) FROM t""")
def null_counts(spark, d):
    t = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("b"), F.col("c_name").alias("c"))
    return agg.null_counts(t).withColumn("share", F.round("share", 6))


@register("a18_circular_statistics", """WITH e AS (SELECT event_type, value AS v FROM events), s AS (SELECT event_type, sum(sin(v)) AS s, sum(cos(v)) AS c, count(v) AS n FROM e GROUP BY 1)
SELECT event_type, round(CASE WHEN atan2(s, c) < 0 THEN atan2(s, c) + 2 * pi() ELSE atan2(s, c) END, 6) AS circmean, round(sqrt(s * s + c * c) / n, 6) AS circr, round(1 - sqrt(s * s + c * c) / n, 6) AS circvar,
  round(sqrt(-2 * ln(sqrt(s * s + c * c) / n)), 6) AS circstd FROM s""")
def circular(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[F.round(x, 6).alias(n) for n, x in agg.circular(F.col("value")).items()])


@register("a19_error_bars", """SELECT l_shipmode, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, list_sort(list(v))[round((count(v) - 1) * 0.25)::INT + 1] AS low, list_sort(list(v))[round((count(v) - 1) * 0.75)::INT + 1] AS high
FROM (SELECT l_linestatus AS l_shipmode, l_extendedprice AS v FROM lineitem) GROUP BY 1""")
def error_bars(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("l_shipmode"), F.col("l_extendedprice").alias("v"))
    return agg.error_bars(rows, ["l_shipmode"], "v").select("l_shipmode", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "low", "high")


@register("a20_score_table", "SELECT o_custkey, round(quantile_cont(o_totalprice, 0.5), 4) AS o_totalprice, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1")
def score_table(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderpriority")
    return agg.score_table(rows, ["o_custkey"]).withColumn("o_totalprice", F.round("o_totalprice", 4))


@register("a21_value_counts", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def value_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


BOXES = "(SELECT l_orderkey AS roi, l_linenumber AS label, (l_partkey % 50)::INT AS x_lower, (l_partkey % 50 + 1 + l_quantity)::INT AS x_upper, (l_suppkey % 50)::INT AS y_lower, (l_suppkey % 50 + 7)::INT AS y_upper FROM lineitem)"


def boxes(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey as roi", "l_linenumber as label", "cast(l_partkey % 50 as int) as x_lower", "cast(l_partkey % 50 + 1 + l_quantity as int) as x_upper", "cast(l_suppkey % 50 as int) as y_lower", "cast(l_suppkey % 50 + 7 as int) as y_upper")


@register("a22_bounding_boxes", f"SELECT roi, min(x_lower) AS x_lower, max(x_upper) AS x_upper, min(y_lower) AS y_lower, max(y_upper) AS y_upper FROM {BOXES} GROUP BY 1")
def union_boxes(spark, d):
    return boxes(spark, d).groupBy("roi").agg(*agg.bounding_box(("x", "y")))


@register("a23_box_extents", f"SELECT label, greatest(x, y) AS x, greatest(x, y) AS y FROM (SELECT label, (ceil((max(x_upper - x_lower) + 4) / 2) * 2)::INT AS x, (ceil((max(y_upper - y_lower) + 4) / 2) * 2)::INT AS y FROM {BOXES} GROUP BY 1)")
def box_extents(spark, d):
    return agg.extents(boxes(spark, d), ["label"], ("x", "y"), padding=2)


@register("a24_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))))
def correlations(spark, d):
    return agg.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 6))


@register("a25_bins_2d", "SELECT floor(l_quantity / 5)::BIGINT AS bx, floor(l_extendedprice / 10000)::BIGINT AS by, l_returnflag AS category, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY ALL")
def bins(spark, d):
    out = agg.bins_2d(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), 5, 10000, F.col("l_discount"), F.col("l_returnflag"))
    return out.withColumn("mean", F.round("mean", 6))


@register("a26_mean_per_roi_channel", "SELECT l_suppkey, l_returnflag, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY ALL")
def mean_per_channel(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@register("a27_mean_joined", "SELECT n_name, round(avg(c_acctbal), 4) AS mean, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def mean_joined(spark, d):
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))
    n = table(spark, d, "nation")
    return per.join(n, per["c_nationkey"] == n["n_nationkey"]).select("n_name", "mean", "n")


@register("a28_dataset_extents", """SELECT min(l) AS x_min, max(u) AS x_max, max(u - l) AS x_size, (SELECT array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') FROM lineitem) AS names FROM (SELECT l_suppkey, min(l_partkey) AS l, max(l_partkey) AS u FROM lineitem GROUP BY 1)""")
def dataset_extents(spark, d):
    sites = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_partkey").alias("x_lower"), F.max("l_partkey").alias("x_upper"), F.collect_set("l_returnflag").alias("names"))
    return agg.dataset_extents(sites, ("x",), ("names",)).withColumn("names", F.array_join("names", ","))


@register("r01_unnest", "SELECT c_custkey AS key, c_name AS \"s.name\", c_acctbal AS \"s.balance\" FROM customer")
def unnest(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("s"))
    return reshape.unnest(t)


@register("r02_unnest_deep", "SELECT c_custkey AS key, c_name AS \"s.t.name\", c_acctbal AS \"s.balance\" FROM customer")
def unnest_deep(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.struct(F.struct(F.col("c_name").alias("name")).alias("t"), F.col("c_acctbal").alias("balance")).alias("s"))
    return reshape.unnest_to(t, 0)


@register("r03_nest_round_trip", "SELECT c_custkey AS key, c_name AS x, c_acctbal AS y, c_nationkey AS b FROM customer")
def nest(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("a.x"), F.col("c_acctbal").alias("a.y"), F.col("c_nationkey").alias("b"))
    return reshape.nest(t).select("key", F.col("a").getField("x").alias("x"), F.col("a").getField("y").alias("y"), "b")


@register("r04_nest_by_pattern", "SELECT c_custkey AS key, c_name AS x, c_acctbal AS y FROM customer")
def nest_by(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("Box-x"), F.col("c_acctbal").alias("Box-y"))
    return reshape.nest_by(t, r"([A-Za-z]+)-([a-z])").select("key", F.col("Box").getField("x").alias("x"), F.col("Box").getField("y").alias("y"))


WIDE = f"""SELECT l_orderkey, {", ".join(f"max(\"Sum\") FILTER (WHERE l_returnflag = '{c}') AS \"{c}_Sum\", max(\"Mean\") FILTER (WHERE l_returnflag = '{c}') AS \"{c}_Mean\"" for c in "ANR")} FROM {TALL} GROUP BY 1"""


@register("r05_tall_to_wide", WIDE)
def to_wide(spark, d):
    return reshape.to_wide(tall(spark, d), ["l_orderkey"], ["l_returnflag"])


@register("r06_wide_to_tall", " UNION ALL ".join(f"SELECT l_orderkey, '{c}' AS channel, \"{c}_Sum\" AS \"Sum\", \"{c}_Mean\" AS \"Mean\" FROM ({WIDE})" for c in "ANR"))
def to_tall(spark, d):
    return reshape.to_tall(reshape.to_wide(tall(spark, d), ["l_orderkey"], ["l_returnflag"], values=["A", "N", "R"]), ["l_orderkey"])


@register("r07_wide_to_tall_without_nulls", f"SELECT l_orderkey, l_returnflag AS channel, \"Sum\", \"Mean\" FROM {TALL}")
def to_tall_complete(spark, d):
    wide = reshape.to_wide(tall(spark, d), ["l_orderkey"], ["l_returnflag"], values=["A", "N", "R"])
    return reshape.to_tall(wide, ["l_orderkey"], r"(.+)_([^_]+)", drop_null=True)


@register("r08_named_value", "SELECT c_custkey, 'c_acctbal' AS name, c_acctbal AS value FROM customer")
def named_value(spark, d):
    return table(spark, d, "customer").select("c_custkey", reshape.named_value("c_acctbal").alias("s")).select("c_custkey", "s.*")


@register("r09_split_channel_pair", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END AS channel, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE o_orderstatus END AS channel_ref FROM orders")
def split_pair(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("channel"))
    return reshape.split_channel_pair(t, "F")


@register("r09_split_channel", "SELECT l_orderkey, l_linenumber, l_returnflag AS stain, l_linenumber AS acquisition FROM lineitem")
def split_channel(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(".", "l_returnflag", "l_linenumber").alias("channel"))
    return reshape.split_channel(t)


@register("r10_r11_melt", "SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax' AS feature, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount', l_discount FROM lineitem")
def melt(spark, d):
    return reshape.melt(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], ["l_tax", "l_discount"])


@register("r12_unstack_without_empty_rows", f"SELECT l_orderkey, max(\"Sum\") FILTER (WHERE l_returnflag = 'A') AS \"Sum_A\", max(\"Sum\") FILTER (WHERE l_returnflag = 'R') AS \"Sum_R\" FROM {TALL} GROUP BY 1 HAVING \"Sum_A\" IS NOT NULL OR \"Sum_R\" IS NOT NULL")
def unstack(spark, d):
    t = tall(spark, d).drop("Mean")
    return reshape.to_wide(t, ["l_orderkey"], ["l_returnflag"], prefix=False, values=["A", "R"]).dropna("all", subset=["Sum_A", "Sum_R"])


@register("r13_container_to_wide", f"""SELECT * FROM (SELECT o_orderkey AS key, o_totalprice AS price FROM orders) FULL JOIN (SELECT l_orderkey AS key, max("Sum") FILTER (WHERE l_returnflag = 'A') AS "A_Sum", max("Sum") FILTER (WHERE l_returnflag = 'N') AS "N_Sum", max("Sum") FILTER (WHERE l_returnflag = 'R') AS "R_Sum" FROM {TALL} GROUP BY 1) USING (key)""")
def container_wide(spark, d):
    t = tall(spark, d).drop("Mean").withColumnRenamed("l_orderkey", "key")
    objects = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    return joins.join_all([objects, reshape.to_wide(t, ["key"], ["l_returnflag"], values=["A", "N", "R"])], ["key"])


@register("r14_horizontal_by_key", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def horizontal(spark, d):
    o = table(spark, d, "orders")
    return joins.join_all([o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderstatus")], ["o_orderkey"], "inner")


@register("j01_join_all", """SELECT coalesce(a.k, b.k, c.k) AS k, a.x, b.y, c.z FROM (SELECT c_custkey AS k, c_acctbal AS x FROM customer) a FULL JOIN (SELECT o_custkey AS k, count(*) AS y FROM orders GROUP BY 1) b ON a.k = b.k
FULL JOIN (SELECT user_id AS k, count(*) AS z FROM events GROUP BY 1) c ON coalesce(a.k, b.k) = c.k""")
def join_all(spark, d):
    """Customers, their orders and users' events by number: some have no orders, some no events."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("y"))
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("z"))
    return joins.join_all([c, o, e], ["k"])


@register("j02_join_on_shared_keys", "SELECT c_custkey AS key_c, c_acctbal, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def join_shared(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key_c"), "c_acctbal")
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key_c")).agg(F.count(F.lit(1)).alias("n"))
    return joins.join_on_shared(c, n, lambda t: names.matching(t, "^key_"), "left", "1:1")


@register("j03_differing_keys", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def differing_keys(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("o_orderkey", "c_name", "n_name")


@register("j04_semi_propagation", "SELECT o_orderkey, o_custkey AS custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def propagate(spark, d):
    t = {"c": table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "custkey"), "o": table(spark, d, "orders").withColumnRenamed("o_custkey", "custkey")}
    return joins.semi_propagate(t, "c", ["custkey"])["o"].select("o_orderkey", "custkey")


@register("j05_consistent_subset", """WITH k AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) SELECT n_name, (SELECT count(*) FROM customer WHERE c_acctbal > 5000 AND c_nationkey = n_nationkey) AS customers FROM nation WHERE n_nationkey IN (SELECT k FROM k)""")
def consistent(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("nk"), "c_custkey")
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nk"), "s_suppkey")
    facts, dims = joins.consistent_subset({"c": c, "s": s}, {"n": (table(spark, d, "nation").withColumnRenamed("n_nationkey", "nk"), "nk")})
    return dims["n"].join(facts["c"].groupBy("nk").agg(F.count(F.lit(1)).alias("customers")), "nk").select("n_name", "customers")


@register("j06_path_assembly", """WITH i AS (SELECT DISTINCT l_suppkey AS roi, l_returnflag AS c, 0 AS m FROM lineitem),
l AS (SELECT 0 AS m, s_suppkey AS roi, CASE WHEN s_nationkey < 12 THEN 'cells' ELSE 'nuclei' END AS o, 'l/' || s_suppkey AS path FROM supplier)
SELECT i.roi, i.c, CASE i.c WHEN 'R' THEN 0 ELSE 1 END AS channel_order, s_nationkey AS site_nation, a.path AS mask_path, CASE WHEN i.c = 'A' THEN 'z/A.pkl' END AS z_model_path, b.path AS z_path, CASE WHEN i.c = 'R' AND i.roi % 2 = 0 THEN 1.5 END AS factor
FROM i JOIN supplier ON roi = s_suppkey LEFT JOIN l a ON a.roi = i.roi AND a.o = CASE i.c WHEN 'R' THEN 'cells' END LEFT JOIN l b ON b.roi = i.roi AND b.o = CASE i.c WHEN 'A' THEN 'nuclei' END WHERE i.c IN ('R', 'A')""")
def paths(spark, d):
    images = table(spark, d, "lineitem").select(F.lit(0).alias("m"), F.col("l_suppkey").alias("roi"), F.col("l_returnflag").alias("c")).distinct().withColumn("path", F.concat_ws("/", F.lit("i"), "roi", "c"))
    s = table(spark, d, "supplier")
    labels = s.select(F.lit(0).alias("m"), F.col("s_suppkey").alias("roi"), F.when(F.col("s_nationkey") < 12, "cells").otherwise("nuclei").alias("o"), F.concat(F.lit("l/"), "s_suppkey").alias("path"), F.lit(1.0).alias("factors"))
    z = spark.createDataFrame([("A", "m1", "nuclei", "z/A.json"), ("R", "m2", "cells", "z/R.json")], "c string, z_model string, o string, path string")
    t = s.where("s_suppkey % 2 = 0").select(F.lit("R").alias("c"), F.col("s_suppkey").alias("roi"), F.lit("t").alias("t_model"), F.lit(1.5).alias("factor"))
    out = joins.image_paths(images, s.select(F.col("s_suppkey").alias("roi"), F.col("s_nationkey").alias("site_nation")), labels, z, t, ["R", "A"], 0, ["cells", None], "m1", "t")
    return out.select("roi", "c", "channel_order", "site_nation", "mask_path", "z_model_path", "z_path", "factor")


@register("j07_correlation_queries", """WITH s AS (SELECT DISTINCT l_suppkey AS site FROM lineitem), a AS (SELECT DISTINCT l_suppkey AS site, l_returnflag AS c FROM lineitem WHERE l_quantity > 45),
p(c0, c1) AS (VALUES ('A', 'N'), ('A', 'R'), ('N', 'R')), v AS (SELECT site, c0, c1, EXISTS (SELECT 1 FROM a WHERE a.site = s.site AND a.c = c0) AND EXISTS (SELECT 1 FROM a WHERE a.site = s.site AND a.c = c1) AS valid FROM s, p)
SELECT *, bool_or(valid) OVER (PARTITION BY site) AS any_valid, bool_and(valid) OVER (PARTITION BY site) AS all_valid FROM v""")
def correlation_queries(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_returnflag").alias("channel"), "l_quantity")
    return joins.pair_queries(rows.select("site").distinct(), rows.where("l_quantity > 45").select("site", "channel").distinct(), ["A", "N", "R"])


@register("j08_boxes_with_channels", """WITH c AS (SELECT l_suppkey AS site, l_returnflag AS c, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS o, max(l_discount) > 0.09 AS iso FROM lineitem GROUP BY ALL),
o AS (SELECT DISTINCT l_suppkey AS site, l_orderkey AS label FROM lineitem)
SELECT site, label, array_to_string(list(c || ':' || CASE WHEN iso THEN label::VARCHAR ELSE '-' END ORDER BY o), ',') AS channels FROM o JOIN c USING (site) GROUP BY ALL""")
def boxes_with_channels(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_orderkey").alias("label"), F.col("l_returnflag").alias("c"), "l_discount")
    order = F.when(F.col("c") == "R", 0).when(F.col("c") == "A", 1).otherwise(2)
    channels = t.groupBy("site", "c").agg(F.max(order).alias("channel_order"), (F.max("l_discount") > 0.09).alias("isolate"))
    out = joins.boxes_with_channels(t.select("site", "label").distinct(), channels, ["site"], ["label"])
    return out.select("site", "label", F.array_join(F.transform("channels", lambda x: F.concat_ws(":", x["c"], F.coalesce(x["label"].cast("string"), F.lit("-")))), ",").alias("channels"))


@register("j09_layers", "SELECT c_custkey, c_acctbal, coalesce(p, 'nan'::DOUBLE) AS \"orders:p\" FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS p FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def layers(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("p"))
    return joins.layers(table(spark, d, "customer").select("c_custkey", "c_acctbal"), {"orders": per}, ["c_custkey"])


@register("c03_selector_algebra", "SELECT p_partkey, p_size, p_retailprice FROM part")
def algebra(spark, d):
    t = table(spark, d, "part")
    return t.select(*names.difference(names.union(names.numeric(t), names.matching(t, "size$")), ["p_name"]))


@register("c09_glob_filter", "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT LIKE 'Brand#1%'")
def globbed(spark, d):
    return names.where_glob(table(spark, d, "part"), "p_brand", ["!Brand#1*"]).select("p_partkey", "p_brand")


@register("c11_missing_resources", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def missing(spark, d):
    """Customers without a pending order."""
    there = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing_names(table(spark, d, "customer"), there, "c_custkey")


@register("c12_request_rows", """WITH r AS (SELECT p_partkey::VARCHAR AS object, CASE p_size % 5 WHEN 0 THEN 'label' WHEN 1 THEN 'intensity' WHEN 2 THEN 'colocalization' WHEN 3 THEN 'distance' ELSE 'density' END AS family FROM part), f(feature) AS (VALUES ('Mean'), ('Sum'))
SELECT family, object, NULL::VARCHAR AS c, NULL::VARCHAR AS c_ref, NULL::VARCHAR AS target, feature FROM r, f WHERE family IN ('label', 'density')
UNION ALL SELECT family, object, c, NULL, NULL, feature FROM r, f, (VALUES ('a.0'), ('b.0'), ('b.1')) c(c) WHERE family = 'intensity'
UNION ALL SELECT family, object, c, c_ref, NULL, feature FROM r, f, (VALUES ('a.0'), ('b.0'), ('b.1')) c(c), (VALUES ('a.0'), ('d.0')) x(c_ref) WHERE family = 'colocalization' AND c <> c_ref
UNION ALL SELECT family, object, NULL, NULL, target, feature FROM r, f, (VALUES ('7'), ('8')) t(target) WHERE family = 'distance' AND target <> object""")
def requests(spark, d):
    families = F.element_at(F.array(*[F.lit(x) for x in ("label", "intensity", "colocalization", "distance", "density")]), (F.col("p_size") % 5 + 1).cast("int"))
    rows = table(spark, d, "part").select(families.alias("family"), F.col("p_partkey").cast("string").alias("object"), F.array(F.lit("Mean"), F.lit("Sum")).alias("features"))
    return joins.request_rows(rows, ["a.0", "b.0", "b.1"], ["a.0", "d.0"], ["7", "8"])


@register("c13_predicates", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT (l_discount = 0 OR l_tax > 0.06)")
def predicates(spark, d):
    t = table(spark, d, "lineitem")
    return t.where(F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "R") & ~((F.col("l_discount") == 0) | (F.col("l_tax") > 0.06))).select("l_orderkey", "l_linenumber", "l_partkey")


@register("w01_z_scores", """SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - avg(l_extendedprice) OVER w) / stddev_samp(l_extendedprice) OVER w, 4) AS z, round(l_extendedprice / avg(l_extendedprice) OVER v, 4) AS m FROM lineitem
WINDOW w AS (PARTITION BY l_returnflag), v AS (PARTITION BY l_returnflag, l_linestatus)""")
def z_scores(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice")
    out = windows.mean_normalised(windows.z_scored(t, "l_extendedprice", ["l_returnflag"]), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("z", 4).alias("z"), F.round("m", 4).alias("m"))


@register("w02_stratified_sample", "SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 50")
def stratified(spark, d):
    return windows.stratified_sample(table(spark, d, "orders"), ["o_orderstatus"], 50, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@register("w03_sliding_samples", """WITH s AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) AS k FROM orders),
t AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM s WHERE k <= 40), p AS (SELECT o_orderpriority, lead(o_orderpriority) OVER (ORDER BY o_orderpriority) AS nx, lag(o_orderpriority) OVER (ORDER BY o_orderpriority) AS pv FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o_orderkey, o_orderpriority, o_orderpriority AS "window" FROM t UNION ALL SELECT o_orderkey, o_orderpriority, o_orderpriority || '-' || nx FROM t JOIN p USING (o_orderpriority) WHERE k > n - 10 AND nx IS NOT NULL
UNION ALL SELECT o_orderkey, o_orderpriority, pv || '-' || o_orderpriority FROM t JOIN p USING (o_orderpriority) WHERE k <= 10 AND pv IS NOT NULL""")
def sliding(spark, d):
    return windows.sliding_samples(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 40, 10, ["o_orderkey"])


@register("w04_track_time", """SELECT event_id, t, round(2 * pi() * t / nullif(max(t) OVER (PARTITION BY user_id), 0), 6) AS phase FROM (SELECT event_id, user_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) AS t FROM events)""")
def track_time(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("m"))
    w = Window.partitionBy("user_id")
    out = windows.track_time(e, "user_id", "m")
    top = F.nullif(F.max("t").over(w), F.lit(0))
    return out.select("event_id", "t", F.round(F.when(top.isNotNull(), F.col("phase")), 6).alias("phase"))


@register("w05_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS r FROM orders")
def rank(spark, d):
    return table(spark, d, "orders").select("o_orderkey", windows.rank0(["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")]).cast("long").alias("r"))


@register("w06_path_length", "SELECT p_partkey, sum((p_size % 2) * 1.5::DOUBLE) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS path FROM part")
def path(spark, d):
    return table(spark, d, "part").select("p_partkey", windows.path_length(F.col("p_size") % 2, 1.5, ["p_brand"], "p_partkey").alias("path"))


@register("o02_best_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def best(spark, d):
    return windows.best(table(spark, d, "orders"), F.col("o_totalprice"), 100, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@register("o04_sample_rows", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def sample_rows(spark, d):
    return windows.sample_rows(table(spark, d, "orders"), 100, ["o_orderkey"]).select("o_orderkey")


@register("o06_every_nth", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k % 3 = 0")
def every_nth(spark, d):
    return windows.every_nth(table(spark, d, "orders"), 3, ["o_custkey"], ["o_orderkey"]).select("o_orderkey")


@register("u01_union_by_name", "SELECT c_custkey AS k, c_acctbal AS bal, NULL::VARCHAR AS s FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier")
def union_by_name(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("s"))
    return a.unionByName(b, allowMissingColumns=True)


@register("u02_u03_sets", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def sets(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@register("f01_f05_scalar_functions", """SELECT l_orderkey, l_linenumber, l_partkey, round(log2(l_quantity), 6) AS a, round(ln(1 + l_tax), 6) AS b, round(cbrt(l_extendedprice), 6) AS c, round(abs(l_discount - 0.05), 6) AS d, split_part(l_returnflag || '-' || l_linestatus, '-', 2) AS e,
  least(greatest(l_quantity, 5), 45) AS f FROM lineitem""")
def scalars(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.log2("l_quantity"), 6).alias("a"), F.round(F.log1p("l_tax"), 6).alias("b"), F.round(F.cbrt("l_extendedprice"), 6).alias("c"), F.round(F.abs(F.col("l_discount") - 0.05), 6).alias("d"),
                                              F.get(F.split(F.concat_ws("-", "l_returnflag", "l_linestatus"), "-"), F.lit(1)).alias("e"), clean.Bounds("l_quantity", 5, 45).clipped().alias("f"))


_GAPS = """(SELECT c_custkey, p AS few, e AS many FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders GROUP BY 1) ON c_custkey = o_custkey LEFT JOIN (SELECT user_id, max(value) AS e FROM events WHERE event_type = 'click' AND value > 60 GROUP BY 1) ON c_custkey = user_id)"""


def with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their dearest order and highest click; either may be missing."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("few"))
    e = table(spark, d, "events").where("event_type = 'click' and value > 60").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("value").alias("many"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").join(e, "c_custkey", "left")


@register("p01_p03_nulls", f"""WITH t AS {_GAPS}, n AS (SELECT (count(*) - count(many)) > 0.05 * count(many) AS gone, (count(*) - count(few)) > 0.05 * count(few) AS few_gone FROM t)
SELECT c_custkey, CASE WHEN NOT few_gone THEN few END AS few, CASE WHEN NOT gone THEN many END AS many FROM t, n WHERE (few_gone OR few IS NOT NULL) AND (gone OR many IS NOT NULL)""")
def null_strategies(spark, d):
    kept = clean.drop_null_columns(with_gaps(spark, d), ["few", "many"], "perc", 0.05)
    out = clean.drop_null_rows(kept, [x for x in ("few", "many") if x in kept.columns])
    return out.select("c_custkey", *[F.col(x) if x in out.columns else F.lit(None).cast("double").alias(x) for x in ("few", "many")])


@register("p03_null_strategies", f"""WITH t AS {_GAPS} SELECT 'skip' AS strategy, count(*) AS n, 3 AS columns FROM t UNION ALL SELECT 'drop_cols', count(*), 1 + (count(*) = count(few))::INT + (count(*) = count(many))::INT FROM t
UNION ALL SELECT 'drop_rows', count(*) FILTER (WHERE few IS NOT NULL AND many IS NOT NULL), 3 FROM t UNION ALL SELECT 'drop_feature_rows', count(few), 3 FROM t UNION ALL SELECT 'drop_all', count(*), 1 + (count(*) = count(few))::INT + (count(*) = count(many))::INT FROM t""")
def all_null_strategies(spark, d):
    t, out = with_gaps(spark, d), None
    for name in ("skip", "drop_cols", "drop_rows", "drop_feature_rows", "drop_all"):
        kept = clean.handle_nulls(t, ["few"] if name == "drop_feature_rows" else ["few", "many"], name)
        row = kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("strategy"), "n", F.lit(len(kept.columns)).alias("columns"))
        out = row if out is None else out.union(row)
    return out


@register("p04_p08_fixed_outliers", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE log2(l_quantity) >= 2 AND log2(l_quantity) <= 5 AND l_extendedprice <= 60000")
def fixed_outliers(spark, d):
    b = [clean.Bounds("l_quantity", 2, 5, "log2"), clean.Bounds("l_extendedprice", 0, 60000)]
    return clean.drop_outliers(table(spark, d, "lineitem"), b).select("l_orderkey", "l_linenumber", "l_partkey")


_Q = "(SELECT list_sort(list(l_extendedprice))[round((count(*) - 1) * {q})::INT + 1] FROM lineitem)"


@register("p05_p09_quantile_clip", f"SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_extendedprice, {_Q.format(q=0.05)}), {_Q.format(q=0.95)}) AS l_extendedprice FROM lineitem")
def quantile_clip(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return clean.clip_outliers(t, clean.quantile_bounds(t, ["l_extendedprice"], 0.05, 0.95))


@register("p06_p07_iqr_summary", f"""WITH q AS (SELECT {_Q.format(q=0.25)} AS a, {_Q.format(q=0.75)} AS b) SELECT 'l_extendedprice' AS column, count(*) FILTER (WHERE l_extendedprice < a - (b - a) * 0.25) AS below, count(*) FILTER (WHERE l_extendedprice > b + (b - a) * 0.25) AS above,
  count(*) FILTER (WHERE l_extendedprice < a - (b - a) * 0.25 OR l_extendedprice > b + (b - a) * 0.25) AS outliers, count(*) AS rows FROM lineitem, q""")
def iqr_summary(spark, d):
    t = table(spark, d, "lineitem")
    return clean.outlier_summary(t, clean.iqr_bounds(t, ["l_extendedprice"], m=1.5))


@register("p13_standard_scaler", """SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w, 6) AS l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)""")
def standard(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    return clean.standard_scaled(t, ["l_quantity"], ["l_returnflag"]).drop("l_returnflag").withColumn("l_quantity", F.round("l_quantity", 6))


@register("p13_robust_scaler", """WITH s AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS w FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - m) / w, 5) AS l_extendedprice FROM lineitem JOIN s USING (l_returnflag)""")
def robust(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice")
    return clean.robust_scaled(t, ["l_extendedprice"], ["l_returnflag"]).drop("l_returnflag").withColumn("l_extendedprice", F.round("l_extendedprice", 5))


@register("p13_power_scaler")
def power(spark, d):
    return clean.power_scaled(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_quantity"])


@register("l01_class_counts", "SELECT CASE WHEN toxic = 1 THEN 'debris' WHEN quality = 0 THEN 'poor' ELSE 'clean' END AS class, count(*) AS n FROM labels GROUP BY 1")
def classes(spark, d):
    from tissuemill.operators import learn

    t = table(spark, d, "labels")
    kind = F.when(F.col("toxic") == 1, F.lit("debris")).otherwise(learn.mapped(F.col("quality"), {0: "poor", 1: "clean"}))
    return t.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@register("l09_confusion", "SELECT quality AS label, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark, d):
    from tissuemill.operators import learn

    return learn.confusion(table(spark, d, "labels"), "quality", "toxic")


@register("l09_roc_curve", """WITH s AS (SELECT n_chars AS score, quality AS y FROM labels JOIN documents USING (doc_id)), g AS (SELECT score, sum(y) AS p, count(*) AS n FROM s GROUP BY 1)
SELECT score, round(sum(p) OVER (ORDER BY score DESC) / sum(p) OVER (), 6) AS tpr, round(sum(n - p) OVER (ORDER BY score DESC) / sum(n - p) OVER (), 6) AS fpr FROM g""")
def roc(spark, d):
    from tissuemill.operators import learn

    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return learn.roc_curve(t, "quality", "n_chars").select("score", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@register("l03_train_test_split", "SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id)) <= round(count(*) OVER (PARTITION BY quality) * 0.7) AS is_train FROM labels")
def split(spark, d):
    from tissuemill.operators import learn

    return learn.train_test_split(table(spark, d, "labels"), "quality", 0.7, ["doc_id"]).select("doc_id", "quality", "is_train")
