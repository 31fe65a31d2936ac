"""Registered queries of composed operators: index columns, grids, neighbourhood dispatch, training sets, drivers over sites."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuemill.functions import grids, index, names
from tissuemill.functions.durable import durable
from tissuemill.operators import aggregate as agg
from tissuemill.operators import clean, decay, hoods, learn, ranked, reshape, voxels, windows
from tissuemill.operators import neighbours as near
from tissuemill.plans.registry import register, table
from tissuemill.plans.source_queries import folder
from tissuemill.plans.space_queries import EDGES, GROWN, PTS, XY, grown_volume, points


@register("c05_index_columns", "SELECT o_orderkey AS label, o_totalprice AS price, n, o_custkey AS _roi FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def index_columns(spark, d):
    """Join on the one index column that is active on both sides."""
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("roi"), F.col("o_orderkey").alias("label"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return index.arranged(index.join(index.set_index(o, ["label"]), n, "inner"))


@register("c01_c02_families", "SELECT l_orderkey AS label, l_quantity AS \"A.0_Mean\", l_discount AS \"A.0|B.1_PearsonR\" FROM lineitem")
def families(spark, d):
    """Columns of two families and the index, of a table with columns of six."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("label"), F.col("l_quantity").alias("A.0_Mean"), F.col("l_discount").alias("A.0|B.1_PearsonR"), F.col("l_tax").alias("RAD:5_Count"), F.col("l_extendedprice").alias("shell-1_Distance"), F.col("l_returnflag").alias("note"))
    return t.select(*[reshape.c(n) for n in names.select(t, "index", "intensity", "correlation")])


_WIDE = {"roi": "l_suppkey", "well": "l_returnflag", "parent.embryo": "l_partkey", "object": "l_linestatus", "label": "l_orderkey", "channel": "l_linenumber", "PhysicalSize": "l_quantity", "TOUCH:1_Count": "l_linenumber + 1", "KNNd:4_Mean": "l_tax", "KNNs:4_Sum": "l_tax * 2",
         "RAD:2.5_Mean": "l_discount", "embryo-1_CentroidDistanceAlongZ": "l_extendedprice", "DistanceToBorder_Maximum": "l_extendedprice * 2", "note": "l_shipdate"}
_CHOSEN = {"site_index": ("roi", "parent.embryo", "object", "label"), "object_index": ("roi", "object", "label"), "hierarchy": ("parent.embryo",), "density": ("TOUCH:1_Count", "KNNd:4_Mean"), "neighborhood": ("TOUCH:1_Count", "KNNd:4_Mean", "KNNs:4_Sum", "RAD:2.5_Mean"),
           "distance": ("embryo-1_CentroidDistanceAlongZ", "DistanceToBorder_Maximum"), "features": ("PhysicalSize", "TOUCH:1_Count", "KNNd:4_Mean", "KNNs:4_Sum", "RAD:2.5_Mean", "embryo-1_CentroidDistanceAlongZ", "DistanceToBorder_Maximum"), "empty": ()}


@register("c01_selections", " UNION ALL ".join(f"SELECT '{k}' AS selection, {len(v)}::INT AS n, count(*) AS rows, round({' + '.join(f'coalesce(sum(hash_({_WIDE[x]})), 0)' for x in v).replace('hash_', '') or '0'}, 2)::DOUBLE AS total FROM (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_quantity, l_tax, l_discount, l_extendedprice, ascii(l_linestatus) AS l_linestatus FROM lineitem)" for k, v in _CHOSEN.items()))
def selections(spark, d):
    """Columns of overlapping selections of a wide table, by the sums of their values."""
    rows = table(spark, d, "lineitem").withColumn("l_linestatus", F.ascii("l_linestatus"))
    t = rows.select(*[F.expr(e).alias(n) for n, e in _WIDE.items()])
    parts = []
    for k in _CHOSEN:
        found = names.chosen(t.columns, k)
        total = sum((F.coalesce(F.sum(reshape.c(x).cast("double")), F.lit(0.0)) for x in found), F.lit(0.0))
        parts.append(t.agg(F.lit(k).alias("selection"), F.lit(len(found)).alias("n"), F.count(F.lit(1)).alias("rows"), F.round(total, 2).alias("total")))
    return functools.reduce(lambda a, b: a.union(b), parts)


@register("c02_index_selections", "SELECT l_suppkey AS \"idx.roi\", l_linestatus AS \"idx.o.parent\", l_orderkey AS \"idx.label.parent\" FROM lineitem")
def index_selections(spark, d):
    """The parent's key columns of a hierarchy table with dotted index columns."""
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("idx.roi"), F.col("l_linestatus").alias("idx.o.parent"), F.col("l_orderkey").alias("idx.label.parent"), F.col("l_returnflag").alias("idx.o.child"), F.col("l_linenumber").alias("idx.label.child"), F.col("l_tax").alias("x"))
    assert names.chosen(t.columns, "idx") == t.columns[:-1] and names.chosen(t.columns, "idx_child") == ["idx.roi", "idx.o.child", "idx.label.child"] and names.chosen(t.columns, "idx_label_object") == ["idx.roi"]
    return t.select(*[reshape.c(n) for n in names.chosen(t.columns, "idx_parent")])


@register("c04_c06_keys_first", "SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_tax, l_partkey FROM lineitem")
def keys_first(spark, d):
    """Key columns cast and moved to the front, nested columns left out."""
    t = table(spark, d, "lineitem").select("l_tax", "l_linenumber", F.struct("l_quantity").alias("nested"), "l_orderkey", "l_partkey")
    return names.keys_first(names.without_structs(t), {"l_orderkey": "string", "l_linenumber": "long", "missing": "int"})


@register("o01_o03_sorted", """SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS place FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def sorted_rows(spark, d):
    """Customers by the length of their order lists, longest first, then by number; places follow that order."""
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("orders"))
    out = ranked.numbered(lists.select("o_custkey", F.size("orders").cast("long").alias("n")), [F.desc("n"), F.asc("o_custkey")], "place")
    return windows.sorted_rows(out, "-n", "o_custkey")


@register("o05_subset", "SELECT o_orderkey, o_custkey % 16 AS cycle FROM orders WHERE o_custkey % 16 BETWEEN 8 AND 12")
def subset(spark, d):
    return windows.subset(table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 16).alias("cycle")))


@register("w07_numbered", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row FROM lineitem")
def numbered(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return ranked.numbered(table(spark, d, "lineitem").select(*keys), keys, "row")


@register("u02_distinct", "SELECT l_suppkey, l_returnflag, min(l_orderkey) AS first FROM lineitem GROUP BY ALL")
def distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_orderkey").alias("first")).dropDuplicates(["l_suppkey", "l_returnflag"])


@register("u03_union_of_keys", "SELECT c_custkey AS k FROM customer UNION SELECT user_id FROM events")
def union_of_keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).union(table(spark, d, "events").select("user_id")).distinct()


WELLS = "(SELECT s_suppkey, chr((66 + s_nationkey % 6)::INT) || lpad((3 + s_nationkey % 9)::VARCHAR, 2, '0') AS well FROM supplier)"


def wells(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", F.format_string("%s%02d", F.char(66 + n % 6), 3 + n % 9).alias("well"))


@register("f11_well_grid", f"SELECT s_suppkey, well, ascii(well) - min(ascii(well)) OVER () AS iy, substr(well, 2)::INT - min(substr(well, 2)::INT) OVER () AS ix FROM {WELLS}")
def well_grid(spark, d):
    return grids.well_grid(wells(spark, d))


@register("f11_site_grids", """WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier),
g AS (SELECT *, ceil(sqrt(n))::BIGINT AS sq, ceil(sqrt(n * 2.0::DOUBLE))::BIGINT AS ry FROM r), h AS (SELECT *, ceil(n / ry)::BIGINT AS rx FROM g)
SELECT 'square' AS form, s_suppkey, i % sq AS iy, i // sq AS ix FROM h UNION ALL SELECT 'rect', s_suppkey, i % rx, i // rx FROM h UNION ALL SELECT 'line', s_suppkey, 0, i FROM h""")
def site_grids(spark, d):
    s, out = table(spark, d, "supplier").select("s_suppkey"), None
    for form in ("square", "rect", "line"):
        part = grids.site_grid(s, "s_suppkey", form).select(F.lit(form).alias("form"), "s_suppkey", "iy", "ix")
        out = part if out is None else out.union(part)
    return out


@register("f12_zero_one", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS x FROM lineitem")
def zero_one(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("x"))
    return clean.zero_one(t, ["x"]).withColumn("x", F.round("x", 6))


@register("f13_row_folds", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_discount, l_tax) AS high, l_discount > 0.05 OR l_tax > 0.05 AS some, l_discount > 0.05 AND l_tax > 0.05 AS every FROM lineitem")
def row_folds(spark, d):
    """Largest of several columns of a row, and whether some or every one passes its bounds."""
    t = table(spark, d, "lineitem")
    above = [clean.Bounds(x, upper=0.05).above() for x in ("l_discount", "l_tax")]
    return t.select("l_orderkey", "l_linenumber", "l_partkey", F.greatest("l_discount", "l_tax").alias("high"), (above[0] | above[1]).alias("some"), (above[0] & above[1]).alias("every"))


@register("f14_world_places", "SELECT p_partkey, round(p_size + (p_partkey % 40 - 20) * 0.325, 6) AS x, round(p_retailprice + (p_partkey % 7) * 0.325, 6) AS y FROM part")
def world_places(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.format_string("B02_px%+05d_py%+05d", F.col("p_partkey") % 40 - 20, F.col("p_partkey") % 7).alias("roi"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return grids.to_world(p, 0.325).select("p_partkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("p10_outlier_strategies", "SELECT 'skip' AS strategy, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem UNION ALL SELECT 'drop', count(*), round(sum(l_quantity), 2) FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 UNION ALL SELECT 'clip', count(*), round(sum(least(greatest(l_quantity, 10), 40)), 2) FROM lineitem")
def outlier_strategies(spark, d):
    t, out = table(spark, d, "lineitem").select("l_quantity"), None
    for name in ("skip", "drop", "clip"):
        row = clean.handle_outliers(t, [clean.Bounds("l_quantity", 10, 40)], name).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total")).select(F.lit(name).alias("strategy"), "n", "total")
        out = row if out is None else out.union(row)
    return out


@register("p11_iqr_fences", """WITH s AS (SELECT list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders), q AS (SELECT v[round((n - 1) * 0.25)::INT + 1] AS a, v[round((n - 1) * 0.75)::INT + 1] AS b FROM s)
SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice BETWEEN a - 0.1 * (b - a) AND b + 0.1 * (b - a)""")
def iqr_fences(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return clean.drop_outliers(o, clean.iqr_fences(o, ["o_totalprice"], 0.1))


@register("p12_log_columns", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + l_quantity), 6) AS \"A.0_Mean\", l_tax AS \"A.0_Ratio\" FROM lineitem")
def log_columns(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("A.0_Mean"), F.col("l_tax").alias("A.0_Ratio"))
    return clean.log1p_matching(t, r"\.\d+_", "_Ratio$").withColumn("A.0_Mean", F.round("`A.0_Mean`", 6))


@register("p13_quantile_scaler", """WITH s AS (SELECT list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders), r AS (SELECT i, v[floor(i * (n - 1) / 20.0)::INT + 1] + (i * (n - 1) / 20.0 - floor(i * (n - 1) / 20.0)) * (v[least(floor(i * (n - 1) / 20.0)::INT + 2, n)] - v[floor(i * (n - 1) / 20.0)::INT + 1]) AS x FROM s, range(21) t(i)),
e AS (SELECT a.i, a.x, b.x AS y FROM r a JOIN r b ON b.i = a.i + 1)
SELECT o_orderkey, round((i + (o_totalprice - x) / (y - x)) / 20.0, 5) AS x FROM orders JOIN e ON o_totalprice > x AND o_totalprice <= y UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_totalprice = (SELECT min(x) FROM r)""")
def quantile_scaler(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    return clean.quantile_scaled(o, ["x"], 21).withColumn("x", F.round("x", 5))


@register("p13_spline_basis", "SELECT o_orderkey, 1.0::DOUBLE AS total, true AS nonnegative FROM orders")
def spline_basis(spark, d):
    """Each row's basis values add up to 1 and none is negative."""
    out = clean.spline_basis(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x")), "x")
    values = [n for n in out.columns if n != "o_orderkey"]
    return out.select("o_orderkey", F.round(sum((F.col(n) for n in values), F.lit(0.0)), 9).alias("total"), (F.least(*values) >= 0).alias("nonnegative"))


@register("h10_h12_queries", f"""SELECT p.site, p.id, count(e.dst) FILTER (WHERE weight <= 1) AS r1, count(e.dst) AS r3, coalesce(sum(e.f) FILTER (WHERE weight <= 1), 0)::DOUBLE AS s1, coalesce(sum(e.f), 0)::DOUBLE AS s3 FROM {PTS} p LEFT JOIN {EDGES} e ON p.site = e.site AND p.id = e.src GROUP BY ALL""")
def dispatched(spark, d):
    """Counts and sums of neighbours for two radii from one call."""
    p = points(spark, d).withColumn("one", F.lit(1))
    queries = hoods.hoods(["radius_adjacency"], [1.0, 3.0])
    out = hoods.aggregated(p, queries, p, ["f", "one"], ["Sum"], XY)
    a, b = (q.label for q in queries)
    return out.select("site", "id", F.col(f"`{a}_Sum__one`").cast("long").alias("r1"), F.col(f"`{b}_Sum__one`").cast("long").alias("r3"), F.col(f"`{a}_Sum__f`").cast("double").alias("s1"), F.col(f"`{b}_Sum__f`").cast("double").alias("s3"))


@register("h11_points_of_labels", f"SELECT roi AS site, label AS id, round(avg(z), 6) AS z, round(avg(y), 6) AS y, round(avg(x), 6) AS x FROM {GROWN} WHERE label <> 0 GROUP BY ALL")
def label_points(spark, d):
    found, _ = hoods.points_of_labels(grown_volume(spark, d).select("roi", "z", "y", "x", "label"))
    return found.select("site", "id", *[F.round(a, 6).alias(a) for a in "zyx"])


@register("h11_points_of_table", "SELECT p_brand AS site, p_partkey AS id, p_size::DOUBLE AS y, p_retailprice AS x FROM part")
def table_points(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.struct(F.col("p_size").alias("y"), F.col("p_retailprice").alias("x")).alias("Centroid"))
    flat = reshape.unnest(p, sep="-")
    found = hoods.points_of(flat, "p_brand", "p_partkey")
    return found.join(hoods.points_of(p, "p_brand", "p_partkey", "Centroid").select("site", "id"), ["site", "id"]).select("site", "id", "y", "x")


@register("x01_neighbour_function", f"SELECT site, src, round(max(f) - min(f), 6)::DOUBLE AS spread FROM {EDGES} GROUP BY ALL")
def neighbour_function(spark, d):
    from tissuemill.operators import graph

    p = points(spark, d)
    # the spread does not depend on the neighbours' order, so points alike in place and value have the same
    spread = lambda some: hoods.neighbour_apply(graph.radius_distance(p, 3.0, XY, sources=some, carry=["f"]), p, "f", lambda v: v.max() - v.min(), "spread").withColumnRenamed("src", "id")
    return near.alike(p, [*XY, "f"], spread).select("site", F.col("id").alias("src"), "spread")


@register("x03_element_wise", "SELECT o_orderkey, round(o_totalprice * 2 + 1, 4) AS x FROM orders")
def element_wise(spark, d):
    def twice(v):
        return v * 2 + 1

    return hoods.element_wise(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", twice, "x").select("o_orderkey", F.round("x", 4).alias("x"))


@register("x04_group_mean", "SELECT o_custkey, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def group_mean(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_totalprice")).alias("v"))
    return lists.select("o_custkey", F.round(hoods.mean_of(F.col("v")), 6).alias("mean"))


@register("v16_batch_correlations", f"SELECT roi, label, 'a' AS c0, 'b' AS c1, round(corr(value, other), 5) AS r FROM {GROWN} WHERE label <> 0 GROUP BY ALL UNION ALL SELECT roi, label, 'a', 'c', round(corr(value, z), 5) FROM {GROWN} WHERE label <> 0 GROUP BY ALL")
def batch_correlations(spark, d):
    v = grown_volume(spark, d)
    channel = lambda name, x: v.select("roi", F.lit(name).alias("c"), "z", "y", "x", F.col(x).cast("double").alias("value"))
    images = channel("a", "value").union(channel("b", "other")).union(channel("c", "z"))
    out = hoods.batch_correlations(v.select("roi", "z", "y", "x", "label"), images, [("a", "b"), ("a", "c")], ["PearsonR"])
    return out.select("roi", "label", "c0", "c1", F.round("PearsonR", 5).alias("r"))


@register("v17_site_features", f"SELECT roi, label, count(*) AS n, round(avg(value * 2), 4) AS mean, round(corr(value * 2, other * 2), 5) AS r FROM {GROWN} WHERE label <> 0 GROUP BY ALL")
def site_features(spark, d):
    v = durable(grown_volume(spark, d), "site-volume")
    images = v.select("roi", F.lit("a").alias("c"), "z", "y", "x", "value").union(v.select("roi", F.lit("b").alias("c"), "z", "y", "x", F.col("other").alias("value")))
    out = hoods.site_features(v.select("roi", "z", "y", "x", "label"), images, {"label": ["NumberOfPixels"], "intensity": ["a"], "colocalization": ["a|b"]}, lambda t: t.withColumn("value", F.col("value") * 2))
    return out.select("roi", "label", F.col("NumberOfPixels").alias("n"), F.round("a_Mean", 4).alias("mean"), F.round("`a|b_PearsonR`", 5).alias("r"))


@register("m08_z_training_set", """WITH l AS (SELECT l_orderkey AS label, max(l_quantity) AS cz, max(l_quantity) * 0.25 AS dz, avg(l_extendedprice) AS r FROM lineitem GROUP BY 1), i AS (SELECT l_orderkey AS label, l_linenumber AS acquisition, round(avg(l_tax), 6) AS "Mean" FROM lineitem GROUP BY ALL),
p AS (SELECT l_orderkey AS label, l_linenumber AS acquisition, max(1 - l_discount) AS r FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT label, acquisition, round(dz, 6) AS embryo, round(cz - dz, 6) AS medium, "Mean" AS mean, round(coalesce(p.r, 1.0), 6) AS r FROM l JOIN i USING (label) LEFT JOIN p USING (label, acquisition) WHERE l.r BETWEEN 20000 AND 45000 AND coalesce(p.r, 1.0) >= 0.95""")
def z_training_set(spark, d):
    t = table(spark, d, "lineitem").withColumns({"roi": F.lit("r"), "object": F.lit("o"), "label": F.col("l_orderkey"), "acquisition": F.col("l_linenumber")})
    key = ["roi", "object", "label"]
    labels = t.groupBy(*key).agg(F.max("l_quantity").alias("Centroid-z"), (F.max("l_quantity") * 0.25).alias("DistanceAlongZ"), F.avg("l_extendedprice").alias("Radius"))
    intensity = t.groupBy(*key, "acquisition").agg(F.round(F.avg("l_tax"), 6).alias("Mean"))
    correlation = t.where("l_returnflag <> 'N'").groupBy(*key, "acquisition").agg(F.max(1 - F.col("l_discount")).alias("PearsonR"))
    out = decay.z_training_set(labels, intensity, correlation, t.select(*key).distinct(), key, [clean.Bounds("Radius", 20000, 45000)], 0.95)
    return out.select("label", "acquisition", F.round("EmbryoPath", 6).alias("embryo"), F.round("MediumPath", 6).alias("medium"), F.col("Mean").alias("mean"), F.round("PearsonR", 6).alias("r"))


_T = """(SELECT l_suppkey AS roi, 'c' || l_linenumber AS channel, l_linenumber * 10.0 AS minutes, s_nationkey % 4 + 8 AS cycle, avg(l_extendedprice) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE l_quantity BETWEEN 4 AND 30 AND s_nationkey % 4 + 8 > 9 AND s_nationkey % 5 <> 0 AND 1 - l_discount > 0.92 GROUP BY ALL)"""


@register("m09_t_training_set", f"""SELECT roi, channel, minutes::DOUBLE AS minutes, cycle, round(m, 7) AS mean, round((m - avg(m) OVER (PARTITION BY channel)) / stddev_samp(m) OVER (PARTITION BY channel), 4) AS z,
  round((m - avg(m) OVER w) / stddev_samp(m) OVER w, 4) AS cz, round(m / avg(m) OVER w, 4) AS norm FROM {_T} WINDOW w AS (PARTITION BY channel, cycle)""")
def t_training_set(spark, d):
    out = _t_means(spark, d)
    return out.select("roi", "channel", "minutes", "cycle", F.round("Mean", 7).alias("mean"), F.round("Mean_ZScore", 4).alias("z"), F.round("Mean_CycleZScore", 4).alias("cz"), F.round("Mean_CycleMeanNorm", 4).alias("norm"))


def _t_means(spark: SparkSession, d: str) -> DataFrame:
    rows = ranked.numbered(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "label").withColumns({"object": F.lit("o"), "roi": F.col("l_suppkey"), "acquisition": F.col("l_linenumber")})
    rows = durable(rows, "t-rows")
    key = ["roi", "object", "label"]
    s = table(spark, d, "supplier")
    meta = s.select(F.col("s_suppkey").alias("roi"), (F.col("s_nationkey") % 4 + 8).alias("cycle"), (F.col("s_nationkey") % 5 == 0).alias("is_control_well"))
    times = rows.select("roi", "acquisition").distinct().withColumn("minutes", F.col("acquisition") * 10.0)
    intensity = rows.select(*key, "acquisition", F.concat(F.lit("c"), "acquisition").alias("channel"), F.col("l_extendedprice").alias("Mean"))
    return decay.t_training_set(intensity, rows.select(*key, F.col("l_quantity").alias("EquivalentSphericalRadius")), rows.select(*key, "acquisition", (1 - F.col("l_discount")).alias("alignmentScore")), times, meta, key, (4, 30), 9, 0.92)


@register("m09_t_factors", f"""WITH t AS {_T}, f AS (SELECT channel, regr_slope(m, minutes) AS a, regr_intercept(m, minutes) AS b FROM (SELECT left(channel, 1) AS channel, minutes::DOUBLE AS minutes, m FROM t) GROUP BY 1)
SELECT roi, minutes::DOUBLE AS minutes, round(b / (a * minutes + b), 5) AS factor FROM (SELECT DISTINCT roi, minutes::DOUBLE AS minutes FROM t), f""")
def t_factors(spark, d):
    """One line over all channels' means, saved and loaded, and the factor of each roi and time."""
    mean = durable(_t_means(spark, d).withColumn("channel", F.substring("channel", 1, 1)), "t-means")
    path = folder(spark)
    decay.save_models(decay.model_table(spark, decay.fit(mean, "channel", ["minutes"], "Mean"), "linear"), path)
    out = decay.t_factors(mean.select("roi", "channel", "minutes").distinct(), decay.load_models(spark, path, "linear"), "linear")
    return out.select("roi", "minutes", F.round("factor", 5).alias("factor"))


@register("l02_training_set", """SELECT l_orderkey, annotation, price, r FROM (SELECT l_orderkey, max(l_extendedprice) AS price, coalesce(max(CASE WHEN l_returnflag = 'A' THEN l_discount END), 0) AS r FROM lineitem GROUP BY 1) JOIN (SELECT o_orderkey, o_orderstatus AS annotation FROM orders) ON l_orderkey = o_orderkey""")
def training_set(spark, d):
    """Annotated orders: a feature with many nulls goes, nulls of a correlation are 0."""
    flagged = lambda flag, x: F.max(F.when(F.col("l_returnflag") == flag, F.col(x)))
    features = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("price"), flagged("A", "l_discount").alias("A.0|B.1_PearsonR"), flagged("R", "l_tax").alias("sparse"))
    features = features.withColumn("A.0|B.1_PearsonR", F.coalesce("`A.0|B.1_PearsonR`", F.lit(0.0)))
    labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("annotation"))
    out = learn.training_set(labels, features, ["l_orderkey"], ["price", "A.0|B.1_PearsonR", "sparse"])
    return out.select("l_orderkey", "annotation", "price", F.col("`A.0|B.1_PearsonR`").alias("r"))


@register("l10_rekeyed", "SELECT o_orderkey AS label, o_orderstatus AS annotation FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def rekeyed(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("label"), F.col("o_orderstatus").alias("annotation"))
    return learn.rekeyed(old, table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("label")).distinct(), ["label"])


@register("l11_tracking_table", "SELECT l_orderkey AS label, l_quantity AS z, l_linenumber AS t FROM lineitem")
def tracking(spark, d):
    t = table(spark, d, "lineitem")
    return learn.tracking_table({i: t.where(F.col("l_linenumber") == i) for i in range(1, 8)}, {"l_orderkey": "label", "l_quantity": "z"})


@register("g03_dense_aggregates", f"SELECT p.site, p.id, coalesce(round(avg(e.f), 6), 'nan'::DOUBLE) AS m FROM {PTS} p LEFT JOIN {EDGES} e ON p.site = e.site AND p.id = e.src AND e.weight > 0 GROUP BY ALL")
def dense(spark, d):
    """A dense matrix keeps edges of positive weight only."""
    from tissuemill.operators import graph

    p = points(spark, d)
    out = near.alike(p, [*XY, "f"], lambda some: near.aggregate(some, graph.radius_distance(p, 3.0, XY, sources=some, carry=["f"]).where("weight > 0"), p, ["f"], ["Mean"], "N"))
    return out.select("site", "id", F.round("N_Mean__f", 6).alias("m"))


@register("a22_box_lists", """SELECT l_suppkey AS roi, array_to_string(list(l_orderkey || ':' || lo || '-' || hi ORDER BY l_orderkey, lo, hi), ',') AS boxes FROM (SELECT l_suppkey, l_orderkey, min(l_partkey) AS lo, max(l_partkey) + 1 AS hi FROM lineitem GROUP BY ALL) GROUP BY 1""")
def box_lists(spark, d):
    boxes = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min("l_partkey").alias("x_lower"), (F.max("l_partkey") + 1).alias("x_upper"))
    listed = agg.box_lists(boxes, ["l_suppkey"], "l_orderkey", ("x",))
    return listed.select(F.col("l_suppkey").alias("roi"), F.array_join(F.transform("boxes", lambda b: F.concat(b["l_orderkey"], F.lit(":"), b["x"]["lower"], F.lit("-"), b["x"]["upper"])), ",").alias("boxes"))


@register("a23_quantile_extents", "SELECT l_suppkey, ceil(list_sort(list(w))[round((count(*) - 1) * 0.9)::INT + 1])::INT AS x FROM (SELECT l_suppkey, max(l_partkey) - min(l_partkey) AS w FROM lineitem GROUP BY l_suppkey, l_orderkey) GROUP BY 1")
def quantile_extents(spark, d):
    boxes = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min("l_partkey").alias("x_lower"), F.max("l_partkey").alias("x_upper"))
    return agg.quantile_extents(boxes, ["l_suppkey"], 0.9, ("x",))


@register("a25_bins_log", "SELECT floor(log10(l_extendedprice) / 0.25)::BIGINT AS bx, floor(l_quantity / 5)::BIGINT AS by, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL")
def log_bins(spark, d):
    return agg.bins_2d(table(spark, d, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity"), 0.25, 5, log_x=True)


@register("a11_one_to_one_branch", "SELECT 'customer' AS o_parent, o_custkey AS label_parent, max(o_totalprice) AS price FROM orders GROUP BY o_custkey HAVING count(*) = 1")
def one_child(spark, d):
    """A hierarchy in which every parent has one child: features are copied."""
    o = table(spark, d, "orders")
    single = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("label"), F.max("o_totalprice").alias("price")).where("n = 1")
    h = single.select(F.lit("order").alias("o_child"), F.col("label").alias("label_child"), F.lit("customer").alias("o_parent"), F.col("o_custkey").alias("label_parent"))
    out = agg.aggregate_hierarchy(single.select(F.lit("order").alias("o"), "label", "price"), h, ["price"], [agg.Sum])
    return out.select("o_parent", "label_parent", F.col("order_price").alias("price"))


@register("f06_first_ordinals", "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY f) - 1 AS ordinal FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS f FROM orders)")
def first_ordinals(spark, d):
    return learn.first_ordinals(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])


@register("h13_stacked_edges", f"""WITH i AS (SELECT site, id, row_number() OVER (ORDER BY site, id) - 1 AS i FROM {PTS}) SELECT a.i AS src, b.i AS dst, round(weight, 6) AS weight FROM {EDGES} e JOIN i a ON e.site = a.site AND e.src = a.id JOIN i b ON e.site = b.site AND e.dst = b.id""")
def stacked(spark, d):
    from tissuemill.operators import graph

    return graph.stacked_within(points(spark, d), 3.0, XY)[1].withColumn("weight", F.round("weight", 6))


@register("g16_touch_counts", f"""WITH v AS (SELECT * FROM {GROWN}), e AS (SELECT a.roi, a.label AS l, b.label AS k FROM v a JOIN v b ON a.roi = b.roi AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.label <> b.label WHERE a.label <> 0 AND b.label <> 0)
SELECT p.roi AS site, p.label AS id, count(DISTINCT k) AS n FROM (SELECT DISTINCT roi, label FROM v WHERE label <> 0) p LEFT JOIN e ON p.roi = e.roi AND p.label = e.l GROUP BY ALL""")
def touch_counts(spark, d):
    from tissuemill.operators import graph

    p, touching = hoods.points_of_labels(grown_volume(spark, d).select("roi", "z", "y", "x", "label"))
    out = near.density(p, graph.radius_distance(p, 1.0), graph.knn_distance(p, 1), [1.0], [1], touching)
    return out.select("site", "id", F.col("`TOUCH:1_Count`").alias("n"))


@register("v05_weighted_principal", f"""WITH m AS (SELECT roi, label, sum(value) AS w, {", ".join(f"sum(value * {a}) / sum(value) AS g{a}" for a in "zyx")}, {", ".join(f"sum(value * {a} * {a}) / sum(value) AS q{a}" for a in "zyx")} FROM {GROWN} WHERE label <> 0 GROUP BY ALL)
SELECT roi, label, round(qz - gz * gz + qy - gy * gy + qx - gx * gx, 5) AS trace FROM m""")
def weighted_principal(spark, d):
    """The principal moments add up to the trace of the weighted covariance."""
    v = grown_volume(spark, d)
    out = voxels.weighted_principal(voxels.weighted_moments(v.drop("value", "other"), v.select("roi", "z", "y", "x", "value")))
    return out.select("roi", "label", F.round(sum((F.col(f"`WeightedPrincipalMoments-{i}`") for i in range(3)), F.lit(0.0)), 5).alias("trace"))


@register("v07_path_along", f"SELECT roi, z, y, x, label, 0.5 * sum(CASE WHEN label IN (2, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY roi, y, x ORDER BY z) AS value FROM {GROWN} QUALIFY label <> 0")
def path_along(spark, d):
    """The way through objects 2 and 3 up to each voxel."""
    v = grown_volume(spark, d).select("roi", "z", "y", "x", "label")
    return voxels.path_along(v, v.where("label in (2, 3)"), "z", 0.5)


@register("v13_scaled_boxes", f"SELECT roi, label, round(min(z) * 0.5)::INT AS z_lower, round((max(z) + 1) * 0.5)::INT AS z_upper FROM {GROWN} WHERE label <> 0 GROUP BY ALL")
def scaled_boxes(spark, d):
    v = grown_volume(spark, d).where("label <> 0")
    boxes = v.groupBy("roi", "label").agg(*[x for a in "zyx" for x in (F.min(a).alias(f"{a}_lower"), (F.max(a) + 1).alias(f"{a}_upper"))])
    return voxels.scale_boxes(boxes, (0.5, 0.5, 0.5)).select("roi", "label", "z_lower", "z_upper")


@register("v02_principal_invariants", f"""WITH m AS (SELECT roi, label, var_pop(z) AS a, var_pop(y) AS b, var_pop(x) AS c, covar_pop(z, y) AS d, covar_pop(z, x) AS e, covar_pop(y, x) AS f FROM {GROWN} WHERE label <> 0 GROUP BY ALL)
SELECT roi, label, round(a + b + c, 5) AS trace, round(a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e), 3) AS determinant, round(a * a + b * b + c * c + 2 * (d * d + e * e + f * f), 4) AS squares FROM m""")
def principal_invariants(spark, d):
    """Principal moments by what does not depend on the axes: sum, product and sum of squares."""
    out = voxels.with_principal(voxels.label_features(grown_volume(spark, d)))
    m = [F.col(f"`PrincipalMoments-{i}`") for i in range(3)]
    return out.select("roi", "label", F.round(m[0] + m[1] + m[2], 5).alias("trace"), F.round(m[0] * m[1] * m[2], 3).alias("determinant"), F.round(m[0] * m[0] + m[1] * m[1] + m[2] * m[2], 4).alias("squares"))
