"""Registered queries of fits over many groups, corrections along paths, sliding samples with rows that must be kept, and classifier searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tissuemill.functions.durable import durable
from tissuemill.operators import decay, graph, joins, learn, lines, windows
from tissuemill.operators import neighbours as near
from tissuemill.plans.registry import register, table
from tissuemill.plans.space_queries import GROWN, PTS, XY, grown_volume, points
from tissuemill.sources import tables

PLACE = ("roi", "z", "y", "x")


@register("m03_fits_of_many_groups", """SELECT l_partkey, CASE WHEN count(DISTINCT l_quantity) > 1 THEN round(regr_slope(l_extendedprice / 10000, l_quantity), 4) END AS slope, CASE WHEN count(DISTINCT l_quantity) > 1 THEN round(regr_intercept(l_extendedprice / 10000, l_quantity), 4) END AS intercept FROM lineitem GROUP BY 1""")
def many_fits(spark, d):
    """A straight line per part: groups grow with the table, and their parameters never pass the driver."""
    t = table(spark, d, "lineitem").select("l_partkey", "l_quantity", (F.col("l_extendedprice") / 10000).alias("v"))
    return decay.fit_table(t, "l_partkey", ["l_quantity"], "v").select("l_partkey", *[F.round(F.get("parameters", F.lit(i)), 4).alias(n) for i, n in enumerate(("slope", "intercept"))])


@register("m02_log_linear_fits", """WITH f AS (SELECT l_suppkey, regr_slope(ln(greatest(l_extendedprice / 1000, 0.000001)), l_quantity) AS a, regr_intercept(ln(greatest(l_extendedprice / 1000, 0.000001)), l_quantity) AS b FROM lineitem GROUP BY 1)
SELECT l_suppkey, 'log_linear' AS kind, round(a, 5) AS slope, round(b, 5) AS height, round(exp(b + 20 * a), 3) AS at20 FROM f UNION ALL SELECT l_suppkey, 'exp_fit_linear', round(a, 5), round(exp(b), 5), round(exp(b) * exp(20 * a), 3) FROM f""")
def log_linear_fits(spark, d):
    """Both kinds of exponentials that are fitted as lines through logarithms, with their predictions at 20."""
    t = durable(table(spark, d, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("v")), "log-linear")
    out = None
    for kind in ("log_linear", "exp_fit_linear"):
        p = decay.fit_table(t, "l_suppkey", ["l_quantity"], "v", kind)
        p = p.select("l_suppkey", F.lit(kind).alias("kind"), F.round(F.get("parameters", F.lit(0)), 5).alias("slope"), F.round(F.get("parameters", F.lit(1)), 5).alias("height"), F.round(decay.predict(kind, F.col("parameters"), [F.lit(20.0)]), 3).alias("at20"))
        out = p if out is None else out.union(p)
    return out


@register("m02_huber_normal_equations", "SELECT DISTINCT l_suppkey, true AS stationary FROM lineitem")
def huber(spark, d):
    """Robust lines by what defines them: at the parameters found, the residuals of each group, the large ones weighted by their inverse root, are orthogonal to the inputs."""
    t = durable(table(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("v")), "huber")
    p = decay.fit_table(t, "l_suppkey", ["x"], "v", "linear", "huber")
    r = decay.predict("linear", F.col("parameters"), [F.col("x")]) - F.col("v")
    w = F.when(r * r <= 1, r).otherwise(F.signum(r))
    sums = t.join(p, "l_suppkey").groupBy("l_suppkey").agg(F.abs(F.avg(w * F.col("x"))).alias("a"), F.abs(F.avg(w)).alias("b"))
    return sums.select("l_suppkey", ((F.col("a") < 1e-4) & (F.col("b") < 1e-4)).alias("stationary"))


@register("m06_two_paths", f"""WITH v AS {GROWN}, p AS (SELECT *, 0.5::DOUBLE * coalesce(sum((label IN (2, 3))::INT) OVER (PARTITION BY roi, y, x ORDER BY z), 0) AS e FROM v), f AS (SELECT *, (z + 1) * 0.5::DOUBLE - e AS m FROM p), k AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + (0.0::DOUBLE + -0.1::DOUBLE * m + -0.2::DOUBLE * e)) AS k FROM f)
SELECT roi, z, y, x, other * CASE WHEN k BETWEEN 0.5 AND 1.5 THEN k ELSE 1.5 END AS value, e AS embryo, m AS medium FROM k""")
def two_paths(spark, d):
    """Values corrected by the ways of light through objects 2 and 3 and beside them; factors outside the range become its upper bound."""
    v = durable(grown_volume(spark, d), "path-volume")
    image, mask = v.select(F.lit("a").alias("c"), *PLACE, F.col("other").alias("value")), v.where("label in (2, 3)").select(*PLACE, "label")
    models = spark.createDataFrame([("a", [-0.1, -0.2, 1.0])], "c string, parameters array<double>")
    out = decay.corrected_by_paths(image, mask, models, "linear", (0.5, 1.5), 0.5)
    paths = lines.with_paths(v.select(*PLACE), mask, "z", 0.5)
    return out.join(paths, list(PLACE)).select(*PLACE, "value", F.col("EmbryoPath").alias("embryo"), F.col("MediumPath").alias("medium"))


@register("w06_runs", f"""WITH v AS {GROWN}, b AS (SELECT *, z - row_number() OVER (PARTITION BY roi, y, x, label ORDER BY z) AS g FROM v) SELECT roi, y, x, min(z) AS "start", max(z) + 1 AS "end", label FROM b GROUP BY roi, y, x, label, g""")
def label_runs(spark, d):
    return lines.runs(grown_volume(spark, d)).select("roi", "y", "x", "start", "end", "label")


_SAMPLE = """s AS (SELECT o_orderkey, o_orderpriority, (o_orderkey % 53 = 0) AS keep, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey % 53 <> 0), md5('42:' || o_orderkey), o_orderkey) AS j FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM s WHERE j <= 90), p AS (SELECT o_orderpriority, lead(o_orderpriority) OVER (ORDER BY o_orderpriority) AS nx, lag(o_orderpriority) OVER (ORDER BY o_orderpriority) AS pv FROM (SELECT DISTINCT o_orderpriority FROM orders))"""


@register("w03_must_keep", f"""WITH {_SAMPLE} SELECT o_orderkey, o_orderpriority AS "window" FROM t UNION ALL SELECT o_orderkey, o_orderpriority || '-' || nx FROM t JOIN p USING (o_orderpriority) WHERE k > n - 25 AND nx IS NOT NULL UNION ALL SELECT o_orderkey, pv || '-' || o_orderpriority FROM t JOIN p USING (o_orderpriority) WHERE k <= 25 AND pv IS NOT NULL""")
def must_keep(spark, d):
    """Ninety orders per priority, those whose number 53 divides among them in any case."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return windows.sliding_samples(o, "o_orderpriority", 90, 25, ["o_orderkey"], must_keep=F.col("o_orderkey") % 53 == 0).select("o_orderkey", "window")


@register("w03_index_relations", f"""WITH {_SAMPLE}, w AS (SELECT o_orderkey, o_orderpriority AS win, k - 1 AS place, 0 AS kind, o_orderpriority AS a FROM t UNION ALL
SELECT o_orderkey, win, row_number() OVER (PARTITION BY win ORDER BY side, k) - 1, 1, a FROM (SELECT o_orderkey, o_orderpriority || '-' || nx AS win, 0 AS side, k, o_orderpriority AS a FROM t JOIN p USING (o_orderpriority) WHERE k > n - 25 AND nx IS NOT NULL UNION ALL SELECT o_orderkey, pv || '-' || o_orderpriority, 1, k, o_orderpriority FROM t JOIN p USING (o_orderpriority) WHERE k <= 25 AND pv IS NOT NULL))
SELECT a.o_orderkey, a.win AS "window", a.place, b.win AS next_window, b.place AS next_place FROM w a JOIN w b ON a.o_orderkey = b.o_orderkey AND (a.kind = 0 AND b.kind = 1 AND starts_with(b.win, a.win || '-') OR a.kind = 1 AND b.kind = 0 AND ends_with(a.win, '-' || b.win))""")
def index_relations(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return windows.sliding_relations(o, "o_orderpriority", 90, 25, ["o_orderkey"], must_keep=F.col("o_orderkey") % 53 == 0)


@register("h01_dense_cells", f"SELECT a.site, a.id AS src, count(*) AS n, round(sum(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))), 4) AS total FROM {PTS} a JOIN {PTS} b ON a.site = b.site AND a.id <> b.id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 64 GROUP BY ALL")
def dense_cells(spark, d):
    """Neighbours within a radius whose cells hold more points than one block takes."""
    e = graph.radius_distance(points(spark, d), 8.0, XY, most=5)
    return e.groupBy("site", "src").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("total"))


def _separable(spark, d):
    """Orders with a class that their customer's number decides."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 7).cast("double").alias("a"), (6 - F.col("o_custkey") % 7).cast("double").alias("b"), F.lit(1.0).alias("flat"))
    return o.withColumn("label", F.col("a").isin(2.0, 5.0).cast("int"))


@register("l04_l07_separable_classes", "SELECT o_orderkey, (o_custkey % 7 IN (2, 5))::INT AS pred, 1.0::DOUBLE AS certain FROM orders")
def separable_classes(spark, d):
    """A balanced forest on classes that its columns decide: every row gets its class, with certainty."""
    t = durable(_separable(spark, d), "separable")
    model = learn.forest_pipeline(["a", "b"], trees=10).fit(learn.balanced_weights(t, "label"))
    return learn.predictions(model, t, ["o_orderkey"]).select("o_orderkey", "pred", F.round(F.array_max("probas"), 2).alias("certain"))


@register("l05_forest_search", "SELECT t AS trees, d AS depth, f AS fold, d >= 4 AS all_right FROM (VALUES (5), (10)) a(t), (VALUES (1), (4)) b(d), range(3) r(f)")
def forest_search(spark, d):
    """Every combination's score in each fold: trees that may be deep enough for the classes get all rows right, stumps do not."""
    t = learn.balanced_weights(durable(_separable(spark, d), "separable"), "label")
    _, scores = learn.forest_search(t, ["a", "b"], ["o_orderkey"], trees=[5, 10], depths=[1, 4])
    return scores.select("trees", "depth", F.col("fold").cast("long").alias("fold"), (F.col("score") == 1).alias("all_right"))


@register("l08_permutation_importance", """WITH r AS (SELECT row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS i, o_custkey % 7 IN (2, 5) AS k, count(*) OVER () AS n FROM orders), s AS (SELECT q, avg((a.k = b.k)::INT) AS hit FROM r a, range(1, 4) t(q), r b WHERE b.i = (a.i + floor(q * a.n / 4.0)::BIGINT) % a.n GROUP BY q)
SELECT 'a' AS feature, round(1 - avg(hit), 9) AS importance FROM s UNION ALL SELECT 'flat', 0.0::DOUBLE""")
def permutation_importance(spark, d):
    """The share of rows that a dealt column misleads; a constant column misleads none."""
    t = durable(_separable(spark, d), "separable")
    model = learn.forest_pipeline(["a", "flat"], trees=10).fit(learn.balanced_weights(t, "label"))
    out = learn.permutation_importance(model, t, ["a", "flat"], ["o_orderkey"])
    return out.select("feature", F.round("importance", 9).alias("importance"))


@register("l06_uncorrelated", "SELECT 'l_quantity' AS kept UNION ALL SELECT 'l_extendedprice' FROM lineitem HAVING abs(corr(l_quantity, l_extendedprice)) <= 0.95 UNION ALL SELECT 'l_discount' FROM lineitem HAVING abs(corr(l_quantity, l_discount)) <= 0.95 AND abs(corr(l_extendedprice, l_discount)) <= 0.95")
def uncorrelated(spark, d):
    """Of a column, its double with a little of another, and two more, those that no earlier one stands for."""
    t = table(spark, d, "lineitem").select("l_quantity", (2 * F.col("l_quantity") + F.col("l_tax")).alias("twice"), "l_extendedprice", "l_discount")
    return spark.createDataFrame([(x,) for x in learn.uncorrelated(t, t.columns)], "kept string")


_FINE = {1: "M pro", 2: "M meta", 3: "M ana", 4: "M telo", 5: "S early", 6: "S late", 7: "debris", 8: "split", 9: "merged"}
_COARSE = {**{i: "M" for i in range(1, 5)}, 5: "S", 6: "S", **{i: "debris/split/merged" for i in range(7, 10)}}
_CLEAN = {**{i: "clean" for i in range(1, 7)}, 7: "debris", 8: "split/merged", 9: "split/merged"}


def _case(classes: dict, of: str = "code") -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in classes.items()) + " END"


def _place(classes: dict) -> str:
    values = list(classes.values())
    return f"CASE {_case(classes)} " + " ".join(f"WHEN '{v}' THEN {values.index(v)}" for v in dict.fromkeys(values)) + " END"


@register("l01_granularities", "SELECT o_orderkey, code, " + ", ".join(f"{_case(m)} AS {n}, {_place(m)} AS {n}int" for n, m in (("fine", _FINE), ("coarse", _COARSE), ("clean", _CLEAN))) + " FROM (SELECT o_orderkey, (1 + o_custkey % 9)::INT AS code FROM orders)")
def granularities(spark, d):
    """Annotations of nine codes at three granularities, with the ordinals of their classes."""
    o = table(spark, d, "orders").select("o_orderkey", (1 + F.col("o_custkey") % 9).cast("int").alias("code"))
    return learn.granularities(o, "code", {"fine": _FINE, "coarse": _COARSE, "clean": _CLEAN})


@register("l01_debris_of_two_sources", "SELECT o_orderkey AS label, o_custkey % 9 = 6 AS is_debris FROM orders UNION ALL SELECT l_orderkey, l_linenumber = 5 FROM lineitem")
def debris(spark, d):
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    return learn.flagged([(o.select(F.col("o_orderkey").alias("label"), (F.col("o_custkey") % 9).alias("a")), "a", 6), (line.select(F.col("l_orderkey").alias("label"), F.col("l_linenumber").alias("a")), "a", 5)], ["label"])


@register("s06_scan_container", """WITH n AS (SELECT chr((65 + c_nationkey % 5)::INT) || lpad((1 + c_nationkey % 7)::VARCHAR, 2, '0') || '_px+0000_py+0000' AS roi, c_custkey AS label, c_acctbal AS value, c_mktsegment AS kind FROM customer), p AS (SELECT o_custkey AS label, avg((o_orderstatus = 'F')::INT) AS debris_proba FROM orders GROUP BY 1),
k AS (SELECT n.*, debris_proba FROM n JOIN p USING (label) WHERE debris_proba < 0.5), m AS (SELECT roi, count(*) AS count FROM k GROUP BY 1)
SELECT k.roi, label, value, kind, count, round(log2(count))::INT AS cycle, left(k.roi, 3) IN ('A01', 'B02') AS is_control_well FROM k JOIN m USING (roi)""")
def scan_container(spark, d):
    """Features with an annotation and a prediction, filtered, and what is derived from the rois that are left."""
    c = table(spark, d, "customer")
    roi = F.concat(F.char(65 + F.col("c_nationkey") % 5), F.lpad((1 + F.col("c_nationkey") % 7).cast("string"), 2, "0"), F.lit("_px+0000_py+0000"))
    nuclei = c.select(roi.alias("roi"), F.lit(1).alias("parent"), F.col("c_custkey").alias("label"), F.col("c_acctbal").alias("value"))
    kinds = c.select(F.col("c_custkey").cast("string").alias("label"), F.col("c_mktsegment").alias("annotation"))
    debris_of = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("int").alias("label")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("debris_proba"))
    out = tables.scan_container({"nuclei": nuclei}, "nuclei", ["label"], {"kind": kinds}, [debris_of], "debris_proba < 0.5", ["A01", "B02"], ["nuclei"])
    return out["nuclei"].select("roi", "label", "value", "kind", "count", "cycle", "is_control_well")


@register("g06_neighbour_indices", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY id) - 1 AS i FROM {PTS}), e AS (SELECT a.site, a.id AS src, b.i FROM p a JOIN p b ON a.site = b.site AND a.id <> b.id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 9)
SELECT p.site, p.id, coalesce(string_agg(e.i::VARCHAR, ',' ORDER BY e.i), '') AS places FROM p LEFT JOIN e ON p.site = e.site AND p.id = e.src GROUP BY ALL""")
def neighbour_indices(spark, d):
    p = points(spark, d)
    return near.neighbour_indices_within(p, 3.0, XY, "R").select("site", "id", F.array_join("R_NeighborIndices", ",").alias("places"))


@register("j09_merged_keys", "SELECT l_orderkey || '__' || l_linenumber || '__' || l_partkey AS key, l_quantity FROM lineitem")
def merged_keys(spark, d):
    return table(spark, d, "lineitem").select(joins.merged_key(["l_orderkey", "l_linenumber", "l_partkey"]).alias("key"), "l_quantity")
