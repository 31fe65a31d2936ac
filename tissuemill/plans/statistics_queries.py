"""Registered queries of order statistics over many columns and groups, scalers per group and in sequence, type lists, hierarchy features and correlation queries."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from tissuemill.functions.durable import durable
from tissuemill.operators import aggregate as agg
from tissuemill.operators import clean, joins, ranked
from tissuemill.plans.registry import register, table
from tissuemill.plans.table_queries import JOINED, children, hierarchy

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE = ("l_orderkey", "l_linenumber", "l_partkey")


@register("a07_quantiles_of_many_columns", " UNION ALL ".join(f"SELECT l_returnflag, '{x}' AS column, count({x}) AS n, round(quantile_cont({x}, 0.1), 6)::DOUBLE AS q10, round(quantile_cont({x}, 0.5), 6)::DOUBLE AS q50, round(quantile_cont({x}, 0.99), 6)::DOUBLE AS q99 FROM lineitem GROUP BY 1" for x in MEASURES))
def many_quantiles(spark, d):
    """Three linear quantiles of four columns per flag, from one pair of passes."""
    out = ranked.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], MEASURES, [0.1, 0.5, 0.99])
    return out.select("l_returnflag", "column", "n", *[F.round(F.get("values", F.lit(i)), 6).alias(n) for i, n in enumerate(("q10", "q50", "q99"))])


@register("a08_quantiles_of_children", f"SELECT 'nation' AS o_parent, c_nationkey::BIGINT AS label_parent, o_orderstatus AS o_child, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS q90 FROM {JOINED} WHERE c_nationkey <> 0 GROUP BY ALL")
def children_quantiles(spark, d):
    out = agg.many_to_one_quantiles(children(spark, d), hierarchy(spark, d), ["price"], {"Median": 0.5, "Q(0.9)": 0.9})
    return out.select("o_parent", "label_parent", "o_child", F.round("price__Median", 4).alias("median"), F.round("`price__Q(0.9)`", 4).alias("q90"))


@register("p13_robust_scaler_many", f"WITH s AS (SELECT l_returnflag, {', '.join(f'quantile_cont({x}, 0.5) AS m_{x}, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS w_{x}' for x in MEASURES)} FROM lineitem GROUP BY 1) SELECT {', '.join(LINE)}, {', '.join(f'round(({x} - m_{x}) / w_{x}, 5) AS {x}' for x in MEASURES)} FROM lineitem JOIN s USING (l_returnflag)")
def robust_many(spark, d):
    t = table(spark, d, "lineitem").select(*LINE, "l_returnflag", *MEASURES)
    return clean.robust_scaled(t, MEASURES, ["l_returnflag"]).drop("l_returnflag").withColumns({x: F.round(x, 5) for x in MEASURES})


@register("p13_scalers_in_sequence", """WITH s AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS w FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, (l_extendedprice - m) / w AS x FROM lineitem JOIN s USING (l_returnflag))
SELECT l_orderkey, l_linenumber, l_partkey, round((x - avg(x) OVER g) / stddev_pop(x) OVER g, 5) AS x FROM r WINDOW g AS (PARTITION BY l_returnflag)""")
def scalers_in_sequence(spark, d):
    t = table(spark, d, "lineitem").select(*LINE, "l_returnflag", F.col("l_extendedprice").alias("x"))
    return clean.scaled(t, ["x"], ["robust", "standard"], ["l_returnflag"]).select(*LINE, F.round("x", 5).alias("x"))


@register("p13_quantile_scaler_per_group", """WITH s AS (SELECT o_orderstatus AS g, list_sort(list(o_totalprice)) AS v, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT *, i * (n - 1) / 10.0::DOUBLE AS place FROM s, range(11) t(i)), r AS (SELECT g, i, v[floor(place)::INT + 1] + (place - floor(place)) * (v[ceil(place)::INT + 1] - v[floor(place)::INT + 1]) AS x FROM p),
e AS (SELECT a.g, a.i, a.x, b.x AS y FROM r a JOIN r b ON b.g = a.g AND b.i = a.i + 1)
SELECT o_orderkey, round((i + (o_totalprice - x) / (y - x)) / 10.0, 5)::DOUBLE AS x FROM orders JOIN e ON g = o_orderstatus AND o_totalprice > x AND o_totalprice <= y UNION ALL SELECT o_orderkey, 0 FROM orders JOIN r ON g = o_orderstatus AND i = 0 AND o_totalprice <= x""")
def quantile_per_group(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("x"))
    return clean.quantile_scaled_by(o, ["x"], ["o_orderstatus"], 11).select("o_orderkey", F.round("x", 5).alias("x"))


_YJ = "CASE WHEN x >= 0 THEN CASE WHEN p = 0 THEN ln(1 + x) ELSE (pow(x + 1, p) - 1) / p END ELSE CASE WHEN p = 2 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - p) - 1) / (2 - p) END END"


@register("p13_power_per_group", f"""WITH v AS (SELECT l_returnflag AS g, 'a' AS c, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'b', l_extendedprice / 10000 - 3 FROM lineitem), k AS (SELECT g, c, x, count(*) AS w FROM v GROUP BY ALL), t AS (SELECT i / 100.0::DOUBLE AS p FROM range(-100, 301) r(i)),
m AS (SELECT g, c, p, sum(w) AS n, sum(w * y) / sum(w) AS mean, sum(w * y * y) AS sq, sum((p - 1) * w * sign(x) * ln(1 + abs(x))) AS j FROM (SELECT *, {_YJ} AS y FROM k, t) GROUP BY ALL)
SELECT g AS l_returnflag, c, arg_max(p, -0.5 * n * ln(sq / n - mean * mean) + j) AS power, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS deviation FROM m GROUP BY ALL""")
def power_per_group(spark, d):
    """The exponent of each group at the maximum of its likelihood, and mean and deviation of what it gives."""
    t = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 10000 - 3).alias("b"))
    powers = durable(clean.power_exponents(t, ["a", "b"], ["l_returnflag"]), "powers")
    scaled = clean.power_scaled(t, ["a", "b"], ["l_returnflag"], powers).groupBy("l_returnflag").agg(*[f(x).alias(f"{x}_{n}") for x in "ab" for n, f in (("mean", F.avg), ("dev", F.stddev_pop))])
    both = powers.join(scaled, "l_returnflag")
    rows = F.array(*[F.struct(F.lit(x).alias("c"), F.round(f"{x}__power", 2).alias("power"), (F.round(f"{x}_mean", 6) + 0.0).alias("mean"), F.round(f"{x}_dev", 6).alias("deviation")) for x in "ab"])
    return both.select("l_returnflag", F.explode(rows).alias("r")).select("l_returnflag", "r.*")


@cache
def _spline_sql(column: str, t: tuple[str, ...], degree: int) -> list[str]:
    """SQL of the periodic B-spline basis by the recursion over degrees, on knots given as SQL."""
    m = len(t) - 1
    knot = lambda i: f"({t[i % m]} + {i // m} * ({t[m]} - {t[0]}))"

    @cache
    def piece(i: int, k: int, shift: int) -> str:
        x = f"({column} + {shift} * ({t[m]} - {t[0]}))"
        if k == 0:
            return f"(CASE WHEN {x} >= {knot(i)} AND {x} < {knot(i + 1)} THEN 1.0::DOUBLE ELSE 0 END)"
        return f"(({x} - {knot(i)}) / ({knot(i + k)} - {knot(i)}) * {piece(i, k - 1, shift)} + ({knot(i + k + 1)} - {x}) / ({knot(i + k + 1)} - {knot(i + 1)}) * {piece(i + 1, k - 1, shift)})"

    return [" + ".join(piece(i, degree, s) for s in (0, 1, 2)) for i in range(m)]


@register("p13_spline_values", f"WITH q AS (SELECT {', '.join(f'quantile_cont(o_totalprice, {k / 4}) AS t{k}' for k in range(5))} FROM orders), v AS (SELECT o_orderkey, CASE WHEN o_totalprice = t4 THEN t0 ELSE o_totalprice END AS x, q.* FROM orders, q) SELECT o_orderkey, {', '.join(f'round({e}, 6) AS s{i}' for i, e in enumerate(_spline_sql('x', tuple(f't{k}' for k in range(5)), 3)))} FROM v")
def spline_values(spark, d):
    out = clean.spline_basis(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x")), "x")
    return out.select("o_orderkey", *[F.round(f"x_s{i}", 6).alias(f"s{i}") for i in range(4)])


_LEVELS_SQL = """(SELECT 'line' AS o_child, l_orderkey * 10 + l_linenumber AS label_child, 'order' AS o_parent, l_orderkey AS label_parent FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, 'part', l_partkey FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)
 UNION ALL SELECT 'order', o_orderkey, 'customer', o_custkey FROM orders)"""


def _levels(spark, d):
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = lambda df, child, label, parent, of: df.select(F.lit(child).alias("o_child"), label.alias("label_child"), F.lit(parent).alias("o_parent"), of.alias("label_parent"))
    return (rows(line.select("l_orderkey", "l_linenumber").distinct(), "line", key, "order", F.col("l_orderkey")).union(rows(line.select("l_orderkey", "l_linenumber", "l_partkey").distinct(), "line", key, "part", F.col("l_partkey")))
            .union(rows(o, "order", F.col("o_orderkey"), "customer", F.col("o_custkey"))))


@register("a12_type_lists", f"""WITH h AS (SELECT * FROM {_LEVELS_SQL} WHERE label_parent <> 0), p AS (SELECT o_child, o_parent, max(n) AS c FROM (SELECT o_child, o_parent, label_parent, count(*) AS n FROM h GROUP BY ALL) GROUP BY ALL), q AS (SELECT o_child, o_parent, max(n) AS p FROM (SELECT o_child, o_parent, label_child, count(*) AS n FROM h GROUP BY ALL) GROUP BY ALL),
k AS (SELECT o_child, o_parent, CASE WHEN c > 1 THEN 'm' ELSE '1' END || ':' || CASE WHEN p > 1 THEN 'm' ELSE '1' END AS k FROM p JOIN q USING (o_child, o_parent)), o(o, level, parents) AS (VALUES ('customer', 0, []), ('part', 0, [NULL]), ('order', 1, ['customer']), ('line', 2, ['part', NULL, 'order'])),
e AS (SELECT o, unnest(parents) AS parent, generate_subscripts(parents, 1) AS i FROM o), l AS (SELECT e.o, string_agg(parent, ',' ORDER BY i) AS parents, string_agg(k, ',' ORDER BY i) AS cardinality, count(parent) AS n FROM e LEFT JOIN k ON e.o = k.o_child AND e.parent = k.o_parent GROUP BY ALL)
SELECT o.o, level, coalesce(l.parents, '') AS parents, coalesce(l.cardinality, '') AS cardinality, (row_number() OVER (ORDER BY level, coalesce(l.n, 0) DESC, o.o) - 1)::INT AS place FROM o LEFT JOIN l ON o.o = l.o""")
def type_lists(spark, d):
    """Three levels: lines of orders and parts, orders of customers; null parents are dropped."""
    types = spark.createDataFrame([("customer", 0, []), ("part", 0, [None]), ("order", 1, ["customer"]), ("line", 2, ["part", None, "order"])], "o string, level int, parents array<string>")
    out = agg.type_lists(types, _levels(spark, d))
    return out.select("o", "level", F.array_join("parents", ",").alias("parents"), F.array_join("cardinality", ",").alias("cardinality"), "place")


@register("a13_hierarchy_features", "SELECT o_custkey, " + ", ".join(f"max(o_totalprice) FILTER (WHERE o_orderstatus = '{s}') AS max_{s}" for s in "FOP") + " FROM orders GROUP BY 1")
def hierarchy_features(spark, d):
    out = agg.hierarchy_features(table(spark, d, "orders").withColumn("object", F.col("o_orderstatus")), ["o_custkey"], ["o_totalprice"], ["F", "O", "P"], F.max, "Max")
    return out.select("o_custkey", *[F.col(f"`{s}_Max.o_totalprice`").alias(f"max_{s}") for s in "FOP"])


def _j07(keep: str) -> str:
    where = {"invalid": "", "any_valid": " WHERE valid", "all_valid": " WHERE valid AND all_valid"}[keep]
    return f"""WITH s AS (SELECT s_suppkey AS roi, s_nationkey % 3 AS well FROM supplier WHERE s_nationkey % 3 IN (0, 2)), i AS (SELECT DISTINCT l_linenumber % 2 AS m, l_suppkey AS roi, l_returnflag AS c FROM lineitem WHERE l_quantity > 47), b AS (SELECT DISTINCT l_linenumber % 2 AS m, l_suppkey AS roi, l_linestatus AS o FROM lineitem WHERE l_tax > 0.07),
p(c0, c1) AS (VALUES ('A', 'N'), ('A', 'R'), ('N', 'R')), q AS (SELECT m::INT AS m, roi, o, c0, c1 FROM s, range(2) t(m), (VALUES ('F'), ('O')) u(o), p),
v AS (SELECT *, EXISTS (SELECT 1 FROM i WHERE i.m = q.m AND i.roi = q.roi AND i.c = q.c0) AND EXISTS (SELECT 1 FROM i WHERE i.m = q.m AND i.roi = q.roi AND i.c = q.c1) AND EXISTS (SELECT 1 FROM b WHERE b.m = q.m AND b.roi = q.roi AND b.o = q.o) AS valid FROM q),
w AS (SELECT *, bool_or(valid) OVER (PARTITION BY m, roi) AS any_valid, bool_and(valid) OVER (PARTITION BY m, roi) AS all_valid FROM v) SELECT * FROM w{where}"""


def _correlation_queries(keep):
    @register(f"j07_level_queries_{keep}", _j07(keep))
    def run(spark, d):
        line, sites = table(spark, d, "lineitem"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("roi"), (F.col("s_nationkey") % 3).cast("string").alias("well"))
        at = [(F.col("l_linenumber") % 2).alias("m"), F.col("l_suppkey").alias("roi")]
        images, labels = line.where("l_quantity > 47").select(*at, F.col("l_returnflag").alias("c")), line.where("l_tax > 0.07").select(*at, F.col("l_linestatus").alias("o"))
        return joins.correlation_queries(sites, images, labels, [0, 1], ["F", "O"], [("A", "N"), ("A", "R"), ("N", "R")], ["0", "2"], keep)


for _keep in ("invalid", "any_valid", "all_valid"):
    _correlation_queries(_keep)


@register("r14_horizontal_tables", """SELECT coalesce(a.k, b.k) AS k, a.price, b.lines, b.quantity FROM (SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT l_orderkey AS k, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) b ON a.k = b.k""")
def horizontal_tables(spark, d):
    """Two tables of which each has keys that the other lacks."""
    a = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    b = table(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))
    return joins.join_all([a, b], ["k"])


@register("u02_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()

