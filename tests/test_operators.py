"""Laws and hand fixtures of the table, neighbourhood, voxel and model operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuemill.functions import grids, index, names
from tissuemill.operators import aggregate, clean, decay, graph, hoods, joins, learn, lines, ranked, reshape, voxels, windows
from tissuemill.operators import neighbours as near
from tissuemill.plans import registry
from tissuemill.sources import tables


@pytest.fixture(scope="module")
def points(spark):
    rows = [("s", i, (i * 37 % 10) / 10, (i * 53 % 7) / 7, (i * 11 % 5) / 5, float(i % 3)) for i in range(10)]
    return spark.createDataFrame(rows, "site string, id long, z double, y double, x double, f double").cache()


def test_radius_laws(points):
    assert graph.radius_distance(points, 0.0).count() == 0
    assert graph.radius_distance(points, 0.0, self_loops=True).count() == 10
    assert graph.radius_distance(points, 100.0, self_loops=True).count() == 100


def test_knn_laws(points):
    assert graph.knn_distance(points, 9).count() == 90
    assert graph.knn_distance(points, 50).count() == 90
    assert graph.knn_distance(points, 1).count() == 10


def test_empty_neighbourhoods(points):
    none = graph.radius_distance(points, 0.0)
    row = near.aggregate(points, none, points, ["f"], ["Sum", "Mean", "Max"], "R").first()
    assert row["R_Sum__f"] == 0 and math.isnan(row["R_Mean__f"]) and math.isnan(row["R_Max__f"])


def test_self_neighbourhoods(points):
    own = graph.radius_distance(points, 0.0, self_loops=True)
    out = near.aggregate(points, own, points, ["f"], ["Mean", "Median", "Std", "CircR"], "R").join(points, ["site", "id"]).collect()
    assert all(r["R_Mean__f"] == r["f"] == r["R_Median__f"] and r["R_Std__f"] == 0 and abs(r["R_CircR__f"] - 1) < 1e-12 for r in out)


def test_exact_steps(spark):
    e = spark.createDataFrame([("s", a, b, 1.0) for a, b in ((1, 2), (2, 3), (3, 4))] + [("s", b, a, 1.0) for a, b in ((1, 2), (2, 3), (3, 4))], "site string, src long, dst long, weight double")
    got = {(r["src"], r["dst"]) for r in graph.n_step(e, 2).collect()}
    assert got == {(1, 3), (3, 1), (2, 4), (4, 2)}
    assert len(graph.n_step(e, 2, self_loops=True).collect()) == 8


def test_outlier_flags(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "a double")
    for t, f in (("identity", lambda v: v), ("log", math.log), ("log2", math.log2), ("log10", math.log10)):
        b = clean.Bounds("a", f(3) - 1e-9, f(6) + 1e-9, t)
        assert sorted(r["a"] for r in df.where(b.outlier()).collect()) == [1, 2, 7, 8, 9, 10]


def test_globs():
    stains = [f"{stain}.{n}" for stain in ("actin", "tubulin", "g-h2ax") for n in range(3)]
    assert names.glob(stains, ["actin.*"]) == ["actin.0", "actin.1", "actin.2"]
    assert names.glob(stains, ["*.1", "tub*"]) == ["actin.1", "tubulin.0", "tubulin.1", "tubulin.2", "g-h2ax.1"]
    assert names.glob(stains, ["!*.0", "!*.2"]) == ["actin.1", "tubulin.1", "g-h2ax.1"]
    assert names.glob_pairs(stains, ["actin.0"], ["g-*"]) == [("actin.0", f"g-h2ax.{n}") for n in range(3)]
    for wrong in (["dapi*"], ["actin*", "!tubulin*"]):
        with pytest.raises(ValueError):
            names.glob(stains, wrong)


def test_nest_round_trip(spark):
    df = spark.createDataFrame([(1.0, 2.0, "r", 3)], ["C.z", "C.y", "idx.roi", "label"])
    assert set(reshape.unnest(reshape.nest(df)).columns) == set(df.columns)


def test_wide_of_no_rows(spark):
    df = spark.createDataFrame([], "k long, ch string, v double")
    assert reshape.to_wide(df, ["k"], ["ch"]).columns == ["k"]


def test_voxel_touch_and_parent(spark):
    rows = [("r", z, y, x, (z // 2) + 1 if y < 2 else 0) for z in range(4) for y in range(4) for x in range(4)]
    v = spark.createDataFrame(rows, "roi string, z int, y int, x int, label int")
    t = {(r["src"], r["dst"]): r["weight"] for r in graph.touch(v.withColumnRenamed("roi", "site")).collect()}
    assert t == {(1, 2): 8.0, (2, 1): 8.0}
    p = voxels.parents(v, v.withColumn("label", F.lit(7)), "e").collect()
    assert {r["parent.e"] for r in p} == {7}
    one = voxels.with_principal(voxels.label_features(v)).where("label = 1").first()
    assert one["NumberOfPixels"] == 16 and one["Elongation"] >= 1


@pytest.mark.parametrize("kind,p,loss", [("linear", [0.5, 3.0], "linear"), ("linear", [0.5, 3.0], "huber"), ("exponential", [-0.01, 5.0], "linear"), ("exponential_offset", [-0.02, 5.0, 1.0], "linear"), ("power", [-0.4, 7.0], "linear"), ("power_offset", [0.5, 2.0, 3.0], "linear")])
def test_fits_recover_parameters(spark, kind, p, loss):
    x = F.col("id").cast("double")
    df = spark.range(2, 202, 2).select(F.lit("c").alias("channel"), x.alias("x"))
    df = df.withColumn("y", decay.predict(kind, F.array(*[F.lit(v) for v in p]), [F.col("x")]))
    got = decay.fit(df, "channel", ["x"], "y", kind, loss)["c"]
    assert all(abs(a - b) < 1e-2 * max(1, abs(b)) for a, b in zip(got, p))


def test_containers(spark, tmp_path):
    t = {"wells": spark.createDataFrame([("a", 1)], "idx string, n int")}
    tables.write_container(t, str(tmp_path), "Resources")
    with pytest.raises(FileExistsError):
        tables.write_container(t, str(tmp_path), "Resources")
    got = tables.read_container(spark, str(tmp_path), "Resources", {"wells": "idx string, n long", "rois": "idx string"})
    assert got["wells"].dtypes == [("idx", "string"), ("n", "bigint")] and got["rois"].count() == 0


def test_fragments_and_merge(spark, tmp_path):
    for roi, obj, v in (("r1", "cells", 1), ("r2", "cells", 2), ("r1", "nuclei", 3)):
        (tmp_path / "f" / roi).mkdir(parents=True, exist_ok=True)
        spark.createDataFrame([(v,)], "v long").toPandas().to_parquet(str(tmp_path / "f" / roi / f"{obj}.parquet"))
    df = tables.read_fragments(spark, str(tmp_path / "f"))
    assert {(r["roi"], r["object"], r["v"]) for r in df.collect()} == {("r1", "cells", 1), ("r2", "cells", 2), ("r1", "nuclei", 3)}
    path = str(tmp_path / "m.parquet")
    tables.write_merged(spark.createDataFrame([(1, 1, 1)], "k int, a int, b int"), path, ["k"])
    tables.write_merged(spark.createDataFrame([(1, 9), (2, 8)], "k int, b int"), path, ["k"], "merge")
    assert sorted((r["k"], r["a"], r["b"]) for r in spark.read.parquet(path).collect() if r["a"]) == [(1, 1, 9)]


def test_xml_records(spark, tmp_path):
    for i, t in enumerate(("2020-01-01T00:00:00", "2021-01-01T00:00:00")):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "m.xml").write_text(f'<R><MeasurementRecord Row="1" Column="2" X="10.2" Y="-3.7" Ch="1" Time="{t}">a</MeasurementRecord></R>')
    got = tables.read_acquisitions(spark, [str(tmp_path / "d0"), str(tmp_path / "d1")]).collect()
    assert len(got) == 1 and got[0]["well"] == "A02" and got[0]["site"] == "px+0010_py-0004" and got[0]["time"].year == 2021


def test_farthest_voxels_and_kendall_without_all_pairs(spark):
    rng = np.random.default_rng(7)
    p = np.unique(rng.integers(0, 40, (3000, 3)), axis=0)
    label = rng.integers(0, 3, len(p))
    uv = rng.integers(0, 50, (len(p), 2)).astype("float64")
    uv[:, 1] += uv[:, 0] * rng.integers(0, 2, len(p))
    rows = [("r", *map(int, q), int(k), float(u), float(v)) for q, k, (u, v) in zip(p, label, uv)]
    df = spark.createDataFrame(rows, "roi string, z int, y int, x int, label int, u double, v double")
    feret = {r["label"]: r["FeretDiameter"] for r in voxels.feret_diameter(df, (2.0, 1.0, 1.0)).collect()}
    colocalized = voxels.colocalization(df.select("roi", "z", "y", "x", "label"), *[df.select("roi", "z", "y", "x", F.col(c).alias("value")) for c in "uv"])
    tau = {r["label"]: r["KendallTau"] for r in colocalized.collect()}
    for k in (1, 2):
        q, (u, v) = p[label == k] * np.array([2.0, 1.0, 1.0]), uv[label == k].T
        assert feret[k] == np.sqrt(((q[:, None] - q[None]) ** 2).sum(-1).max())
        du, dv = np.sign(u[:, None] - u), np.sign(v[:, None] - v)
        assert abs(tau[k] - (du * dv).sum() / np.sqrt((du != 0).sum() * (dv != 0).sum())) < 1e-12
    wide = spark.range(40000).selectExpr("'r' as roi", "0 as z", "0 as y", "cast(id as int) as x", "1 as label", "cast(id as double) as value")
    assert voxels.colocalization(wide.drop("value"), wide.drop("label"), wide.drop("label")).first()["KendallTau"] == 1.0


def test_grown_voxel_queries_follow_the_table(spark):
    found = registry.queries()
    assert sum(n.endswith("_grown") for n in found) == 15
    n = [found["v12_block_mean_grown"](spark, f"/root/testdata/sf{s}").count() for s in ("0.001", "0.01")]
    assert n[1] > 8 * n[0]


def test_border_distance_reaches_across_missing_voxels(spark):
    v = spark.createDataFrame([("r", 0, 0, 0, 1), ("r", 1, 1, 1, 0), ("r", 0, 3, 0, 0)], "roi string, z int, y int, x int, label int")
    assert {(r["z"], r["y"]): r["value"] for r in voxels.border_distance(v, squared=True).collect()} == {(0, 0): 3.0, (1, 1): 0.0, (0, 3): 0.0}


def test_null_strategies(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, nan, None), (2, None, 2.0, None), (3, 3.0, 3.0, None)], "k int, a double, b double, c double")
    kept = {n: clean.handle_nulls(df, ["a", "b"], n) for n in ("skip", "drop_cols", "drop_rows", "drop_feature_rows", "drop_all")}
    assert kept["skip"].where("b is null").count() == 1 and kept["skip"].where(F.isnan("b")).count() == 0
    assert kept["drop_cols"].columns == ["k", "c"] and kept["drop_cols"].count() == 3
    assert kept["drop_rows"].count() == 0 and [r["k"] for r in kept["drop_feature_rows"].collect()] == [3]
    assert kept["drop_all"].columns == ["k", "c"] and kept["drop_all"].count() == 0
    with pytest.raises(ValueError):
        clean.handle_nulls(df, ["a"], "none")


def test_repeated_keys_fail_the_pivot(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "k long, ch string, v double")
    assert {tuple(r) for r in reshape.to_wide(df, ["k"], ["ch"]).collect()} == {(1, 1.0, 2.0), (2, 3.0, None)}
    with pytest.raises(Exception, match="repeats"):
        reshape.to_wide(df.union(df.limit(1)), ["k"], ["ch"]).collect()
    with pytest.raises(ValueError):
        reshape.to_wide(df, ["k"], ["ch"], most_values=1)


def test_order_statistics_of_few_large_groups(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("v")).union(spark.createDataFrame([(None, 5.0), (None, None)], "g boolean, v double"))
    rows = [(r["g"], r["v"]) for r in df.collect() if r["v"] is not None]
    got = {r["g"]: r for r in ranked.values_at(df, ["g"], "v", {"low": F.lit(0), "mid": F.round((F.col("all") - 1) * 0.5), "out": F.col("all")}).collect()}
    for g in (True, False, None):
        v = sorted(x for k, x in rows if k == g)
        assert (got[g]["low"], got[g]["mid"], got[g]["out"]) == (v[0], v[math.floor((len(v) - 1) * 0.5 + 0.5)], None)
    assert {r["g"]: r["median"] for r in aggregate.medians(df, ["g"], "v").collect()}[True] == float(np.median([x for k, x in rows if k]))
    numbers = ranked.numbered(df.where("g"), ["v"]).collect()
    assert sorted(r["_row"] for r in numbers) == list(range(1000)) and [r["v"] for r in sorted(numbers, key=lambda r: r["_row"])] == sorted(x for k, x in rows if k)


def test_no_task_holds_a_group(spark):
    """One flag on nine tenths of the rows: quantiles, z-scores, samples, splits and curves leave no task with most of them."""
    n = 40_000
    df = spark.range(n).select("id", (F.col("id") % 10 == 0).cast("int").alias("flag"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    plans = {
        "quantiles": aggregate.quantile_nearest_rows(df, ["flag"], "v", [0.25]), "z": windows.z_scored(df, "v", ["flag"]), "sample": windows.stratified_sample(df, ["flag"], 50, ["id"]),
        "split": learn.train_test_split(df, "flag", 0.7, ["id"]), "curve": learn.roc_curve(df, "flag", "v"),
    }
    for name, plan in plans.items():
        lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
        over = [line for line in lines if "Window [" in line and not any(x in line for x in ("_range", "_deal", "_before_", "_bracket"))]
        # a sample is taken per part of a stratum first, and only then among what is left of them
        assert len(over) == (1 if name == "sample" else 0), (name, over)
    assert plans["z"].count() == n and plans["sample"].count() == 100 and plans["split"].where("is_train").count() == 28_000


def test_merge_leaves_one_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    tables.write_merged(spark.createDataFrame([(1, 1)], "k int, a int"), path, ["k"])
    tables.write_merged(spark.createDataFrame([(1, 2)], "k int, b int"), path, ["k"], "merge")
    assert [tuple(r) for r in spark.read.parquet(path).select("k", "a", "b").collect()] == [(1, 1, 2)]
    assert [x.name for x in tmp_path.iterdir()] == ["t.parquet"]


def test_index_columns(spark):
    df = spark.createDataFrame([(1.0, "r", 7, "o")], "x double, roi string, label long, object string")
    only = index.set_index(df, ["label"])
    assert only.columns == ["label", "x", "_roi", "_object"] and index.activate(only, ["roi"]).columns == ["label", "roi", "x", "_object"]
    assert index.arranged(df).columns == ["roi", "object", "label", "x"] and index.deactivate(df, ["roi"]).columns == ["label", "object", "x", "_roi"]


def test_grids(spark):
    sites = spark.createDataFrame([(f"s{i}",) for i in range(5)], "site string")
    place = lambda form, **k: {r["site"]: (r["iy"], r["ix"]) for r in grids.site_grid(sites, "site", form, **k).collect()}
    assert place("line") == {f"s{i}": (0, i) for i in range(5)}
    assert place("square") == {"s0": (0, 0), "s1": (1, 0), "s2": (2, 0), "s3": (0, 1), "s4": (1, 1)}
    assert place("square", left_to_right=False)["s3"] == (1, 0)
    assert grids.site_offsets(spark.createDataFrame([("B02_px+0010_py-0004",), ("B02",)], "roi string")).collect()[0][1:] == ("B02", 10, -4)


def test_queries_by_name(points):
    by = {k: hoods.neighbourhood(points, hoods.Hood(k, 3)).count() for k in ("knn_distance", "knn_adjacency", "knn_kernel")}
    assert set(by.values()) == {30}
    assert hoods.Hood("radius_distance", 5.0, True).label != hoods.Hood("radius_adjacency", 5.0).label
    assert len(hoods.hoods(["knn_kernel", "knn_distance"], [1, 2], kernels=["gaussian", "uniform"])) == 6
    with pytest.raises(ValueError):
        hoods.Hood("voronoi", 1)
    for given in ("touch", "delaunay"):
        with pytest.raises(ValueError):
            hoods.neighbourhood(points, hoods.Hood(given, 1))


def test_nesting_forms(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`A_x_m` int, `A_x_n` int, `B_x_m` int, c int")
    assert reshape.nest_at(df, "_", 0).schema["A"].dataType.names == ["x_m", "x_n"] and reshape.nest_at(df, "_", -1).schema["m"].dataType.names == ["A_x", "B_x"]
    assert reshape.nest(df, "_", level=0).columns == ["A", "B_x_m", "c"] and reshape.nest(df, "_", keep="before").columns[0] == "A_x_"
    assert joins.request_rows(spark.createDataFrame([("label", "o", ["a", "b"])], "family string, object string, features array<string>"), ["x"]).count() == 2


def test_spline_basis_is_smooth_and_periodic(spark):
    df = spark.range(1001).select((F.col("id") / 10).alias("x"))
    out = clean.spline_basis(df.withColumn("at", F.col("x")), "x").orderBy("at").toPandas().drop(columns="at").to_numpy()
    assert np.allclose(out.sum(1), 1) and (out >= 0).all() and np.allclose(out[0], out[-1]) and np.abs(np.diff(out, axis=0)).max() < 0.01


def test_element_wise_and_sweep(spark):
    def half(v):
        return v / 2

    assert hoods.element_wise(spark.range(3), "id", half, "h").agg(F.sum("h")).first()[0] == 1.5
    assert learn.parameter_sweep(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    from tissuemill.functions import durable as d

    with d.scratch(spark) as outer:
        with d.scratch(spark) as inner:
            gone = d.durable(spark.range(3), "gone").inputFiles()
            kept = outer(spark.range(5), "kept")
            later = inner(spark.range(4), "later")
        assert later.count() == 4 and not any(Path(f.removeprefix("file://")).exists() for f in gone)
        middle = later.inputFiles()
    assert kept.count() == 5 and not any(Path(f.removeprefix("file://")).exists() for f in middle)


def test_nearest_of_clustered_points(spark):
    """Two sites of unlike density, one with a dense clump and repeated places."""
    rng = np.random.default_rng(4)
    far, clump = rng.random((150, 2)) * 1e4, rng.random((350, 2)) * 1e-3
    clump[300:] = clump[300]
    rows = [("a", i, float(y), float(x)) for i, (y, x) in enumerate(np.concatenate((far, clump)))] + [("b", i, float(i), 0.0) for i in range(4)] + [("c", 0, 1.0, 1.0)]
    got = {}
    for r in graph.knn_distance(spark.createDataFrame(rows, "site string, id long, y double, x double"), 5, ("y", "x")).collect():
        got.setdefault((r["site"], r["src"]), []).append((r["weight"], r["dst"]))
    for s, n in (("a", 5), ("b", 3)):
        p = np.array([(y, x) for k, _, y, x in rows if k == s])
        d = np.sqrt((p[:, None, 0] - p[None, :, 0]) ** 2 + (p[:, None, 1] - p[None, :, 1]) ** 2)
        for i in range(len(p)):
            want = sorted((d[i, j], j) for j in range(len(p)) if j != i)[:n]
            assert [j for _, j in sorted(got[s, i])] == [j for _, j in want]
    assert ("c", 0) not in got


def test_border_distance_is_the_nearest_background(spark):
    """Against all pairs, with gaps in the grid and unlike spacings; no plan joins or fills the grid."""
    rng = np.random.default_rng(0)
    rows = [(roi, 2 * z, y, x - 3, int(rng.random() < 0.97)) for roi, n in (("a", 9), ("b", 5)) for z in range(n) for y in range(n + 3) for x in range(n + 1) if rng.random() < 0.6]
    df = spark.createDataFrame([*rows, ("c", 0, 0, 0, 1)], "roi string, z int, y int, x int, label int")
    for scale in ((1, 1, 1), (2.0, 0.325, 0.5)):
        got = {tuple(r)[:4]: r["value"] for r in voxels.border_distance(df, scale, squared=True).collect()}
        assert len(got) == len(rows) + 1 and got["c", 0, 0, 0] == math.inf
        for roi in "ab":
            p = np.array([r[1:] for r in rows if r[0] == roi], float)
            q, inside = p[:, :3] * np.array(scale), p[:, 3] == 1
            for at, c, i in zip(p, q, inside):
                want = ((q[~inside] - c) ** 2).sum(1).min() if i else 0
                assert abs(got[(roi, *map(int, at[:3]))] - want) < 1e-9


def test_lower_envelope():
    rng = np.random.default_rng(1)
    f = np.where(rng.random((40, 30)) < 0.5, np.inf, rng.random((40, 30)) * 200)
    f[3] = np.inf
    at, to = np.cumsum(rng.random(30) + 0.1), np.sort(rng.random(25) * 20)
    want = (f[:, :, None] + (to[None, None] - at[None, :, None]) ** 2).min(1)
    assert np.allclose(voxels._lower_envelope(f, at, to), want)


def test_pyramid_schedule():
    assert voxels.pyramid_schedule((1, 0.325, 0.325), 3) == [(1, 2, 2), (1, 4, 4), (2, 8, 8)]
    assert voxels.pyramid_schedule((1.8, 1, 1), 2) == [(1, 2, 2), (2, 4, 4)]
    assert voxels.pyramid_schedule((1, 1, 1), 2) == [(2, 2, 2), (4, 4, 4)]


def test_boxes_meet_voxels_of_their_cubes_alone(spark):
    v = spark.range(4000).selectExpr("'r' as roi", "cast(id % 20 as int) as z", "cast(id div 20 % 20 as int) as y", "cast(id div 400 as int) as x", "1 as label")
    box = spark.createDataFrame([("r", 1, 3, 7, 0, 20, 2, 5), ("r", 2, 16, 18, 16, 17, 0, 1), ("r", 3, 5, 5, 0, 9, 0, 9)], "roi string, label int, z_lower int, z_upper int, y_lower int, y_upper int, x_lower int, x_upper int")
    out = voxels.crop(v, box, cell=8)
    assert {(r["object"], r["count"]) for r in out.groupBy("object").count().collect()} == {(1, 4 * 20 * 3), (2, 2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and all(f"_{a}#" in plan.split("Join Inner")[1].split("\n")[0] for a in "zyx")


def test_scopes_of_equal_content_are_told_apart(spark):
    from pathlib import Path

    from tissuemill.functions import durable as d

    with d.scratch(spark):
        with d.scratch(spark):
            pass
        path = d.durable(spark.range(3), "late").inputFiles()[0].removeprefix("file://")
    assert not Path(path).exists()


def test_all_channel_pairs_scan_the_images_once(spark):
    v = spark.range(60).selectExpr("'r' as roi", "0 as z", "cast(id div 10 as int) as y", "cast(id % 10 as int) as x", "cast(id % 2 + 1 as int) as label")
    names = [f"c{i}" for i in range(5)]
    images = v.crossJoin(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "c string, i int")).selectExpr("roi", "z", "y", "x", "c", "cast((x + 1) * (i + 1) + pow(y, i % 3) as double) as value")
    out = hoods.batch_correlations(v, images.where("c <> 'c4' or x > 3"), keep=["PearsonR", "SpearmanR"])
    assert out.count() == 20 and out.where("PearsonR is null").count() == 0
    one = voxels.colocalization(v, images.where("c = 'c0'").drop("c", "i"), images.where("c = 'c2'").drop("c", "i")).select("label", "PearsonR", "KendallTau", "MutualInfo").orderBy("label").collect()
    two = out.where("c0 = 'c0' and c1 = 'c2'").orderBy("label").collect()
    assert all(abs(a["PearsonR"] - b["PearsonR"]) < 1e-12 for a, b in zip(one, two, strict=True)) and all(r["KendallTau"] is not None for r in one)


def test_quantiles_of_many_columns_and_groups(spark, monkeypatch):
    """Against numpy, with brackets (a small accuracy), ties, NaN, null groups and columns without values."""
    monkeypatch.setattr(ranked, "_ACCURACY", 200)
    rng = np.random.default_rng(3)
    rows = [(g, float(a), int(b), None) for g, n in ((None, 700), (1, 5000), (2, 3)) for a, b in zip(rng.normal(size=n).round(2), rng.integers(0, 40, n))] + [(1, float("nan"), 5, None), (3, None, None, None)]
    df = spark.createDataFrame(rows, "g int, a double, b int, z double")
    qs = [0.0, 0.1, 0.5, 0.93, 1.0]
    for linear in (True, False):
        got = {(r["g"], r["column"]): r for r in ranked.quantiles(df, ["g"], ["a", "b", "z"], qs, linear).collect()}
        assert set(got) == {(g, x) for g in (None, 1, 2) for x in "ab"}
        for (g, x), r in got.items():
            v = np.sort([row["ab".index(x) + 1] for row in rows if row[0] == g and row["ab".index(x) + 1] is not None])
            at = [(len(v) - 1) * q for q in qs]
            want = [v[int(p)] + (v[math.ceil(p)] - v[int(p)]) * (p - int(p)) if p > int(p) else v[int(p)] for p in at] if linear else [v[math.floor(p + 0.5)] for p in at]
            assert r["n"] == len(v) and np.allclose(r["values"], want, equal_nan=True)
    whole = ranked.quantiles(df, [], ["b"], [0.5]).collect()
    assert len(whole) == 1 and whole[0]["values"][0] == float(np.median([r[2] for r in rows if r[2] is not None]))


def test_quantiles_read_all_columns_in_two_passes(spark, tmp_path):
    spark.range(1000).select(*[((F.col("id") * (i + 3)) % 101).cast("double").alias(f"c{i}") for i in range(50)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    bounds = clean.quantile_bounds(df, df.columns, 0.1, 0.9)
    assert [b.column for b in bounds] == df.columns and all(b.lower < b.upper for b in bounds)
    plan = ranked.quantiles(df, [], df.columns, [0.1, 0.9])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [c0#") == 1 and plan.count("Relation [_e_0#") == 1


def test_scalers_by_name(spark):
    df = spark.createDataFrame([(g, float(v), 7.0) for g in "ab" for v in (1, 2, 4, 8, 100)], "g string, v double, k double")
    out = clean.scaled(df, ["v", "k"], ["power", "standard"], ["g"]).collect()
    assert abs(sum(r["v"] for r in out)) < 1e-6 and all(r["k"] == 0 for r in out) and len(out) == 10
    with pytest.raises(ValueError):
        clean.scaled(df, ["v"], ["none"])


def test_dense_cells_are_dealt_over_blocks(spark):
    """A clump of 10,000 points in one cell: no key of the join holds more than a block of either side, and every pair meets at one key."""
    p = spark.range(10_000).select(F.lit("s").alias("site"), "id", (F.col("id") % 100 / 1000).alias("y"), (F.floor(F.col("id") / 100) / 1000).alias("x")).union(spark.createDataFrame([("s", 20_000, 5.0, 5.0)], "site string, id long, y double, x double"))
    left, right, keys = graph._dealt(*graph._sides(p, ("y", "x"), 1.0, 1), ["site", "g_y", "g_x"], 1000)
    # what looks into cells without points is left as it is, as it meets nothing
    for side, name in ((left.where("g_y = 0 and g_x = 0"), "src"), (right, "dst")):
        assert side.groupBy(*keys).count().agg(F.max("count")).first()[0] < 1200, name
    own = left.where("g_y = 0 and g_x = 0").select("src", "_bl", "_br").where("src in (3, 7777)")
    met = own.join(right.where("g_y = 0 and g_x = 0").select("dst", "_bl", "_br"), ["_bl", "_br"]).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("different")).collect()
    assert [(r["n"], r["different"]) for r in met] == [(10_000, 10_000)] * 2
    few = p.where("id < 400 or id = 20000")
    edges = {k: {tuple(r) for r in graph.radius_distance(few, 0.05, ("y", "x"), most=k).select("src", "dst").collect()} for k in (20, 4096)}
    assert edges[20] == edges[4096] and edges[20]


def test_runs_give_faces_touch_and_paths(spark):
    rng = np.random.default_rng(8)
    v = {(z, y, x): int(rng.integers(0, 3)) for z in range(5) for y in range(6) for x in range(7) if rng.random() < 0.8}
    df = spark.createDataFrame([("r", *p, k) for p, k in v.items()], "roi string, z int, y int, x int, label int")
    area, faces, touching = {0: 6.0, 1: 3.0, 2: 2.0}, {}, {}
    for p, k in v.items():
        for a in range(3):
            for s in (-1, 1):
                other = v.get(tuple(c + s * (i == a) for i, c in enumerate(p)))
                if other != k:
                    faces[k] = faces.get(k, 0) + area[a]
                    if other is not None:
                        touching[k, other] = touching.get((k, other), 0) + area[a]
    scale = (1.0, 2.0, 3.0)
    assert {r["label"]: r["Perimeter"] for r in lines.perimeter(df, scale).collect()} == {k: a for k, a in faces.items() if k}
    assert {(r["src"], r["dst"]): r["weight"] for r in lines.touch_areas(df.withColumnRenamed("roi", "site"), scale).collect()} == touching
    for r in lines.with_paths(df, df.where("label = 2"), "x", 0.5).collect():
        n = sum(v.get((r["z"], r["y"], x)) == 2 for x in range(r["x"] + 1))
        assert (r["EmbryoPath"], r["MediumPath"]) == (n / 2, (r["x"] + 1 - n) / 2)


def test_fits_of_many_groups(spark):
    df = spark.range(600_000).select((F.col("id") % 200_000).alias("g"), F.floor(F.col("id") / 200_000).cast("double").alias("x")).withColumn("y", F.col("x") * (F.col("g") % 7) + F.col("g") % 11)
    out = decay.fit_table(df, "g", ["x"], "y")
    assert out.where((F.abs(F.get("parameters", F.lit(0)) - F.col("g") % 7) < 1e-9) & (F.abs(F.get("parameters", F.lit(1)) - F.col("g") % 11) < 1e-9)).count() == 200_000
    few = df.where("g < 5").union(spark.createDataFrame([(9, 1.0, 2.0), (None, 1.0, 2.0)], "g long, x double, y double"))
    assert {r["g"]: r["parameters"] is None for r in decay.fit_table(few, "g", ["x"], "y").collect()} == {**dict.fromkeys(range(5), False), 9: True}


def test_queries_of_unknown_choices(spark):
    empty = spark.createDataFrame([], "m int, roi string, c string, o string")
    with pytest.raises(ValueError):
        joins.correlation_queries(empty, empty, empty, [0], ["a"], [("x", "y")], keep="most")
    with pytest.raises(ValueError):
        names.where_glob(spark.createDataFrame([("a",)], "v string"), "v", ["b*"])
    assert [r["v"] for r in names.where_glob(spark.createDataFrame([("a.b",), ("axb",), (None,)], "v string"), "v", ["!a.*"]).collect()] == ["axb", None]
    with pytest.raises(Exception, match="holds"):
        spark.createDataFrame([("a__b", "c")], "k string, l string").select(joins.merged_key(["k", "l"])).collect()


def test_points_at_one_place_share_their_edges(spark):
    """Results equal those over every point's own edges, also where points at one place differ in value or a site is null."""
    rows = [(site, i, float(i % 7), float(i % 3), i * 5 % 4) for site in ("s", None) for i in range(60)]
    p = spark.createDataFrame(rows, "site string, id long, y double, x double, f int")
    every = near.aggregate(p, graph.radius_distance(p, 2.0, ("y", "x")), p, ["f"], ["Min", "Median", "Sum", "Std"], "R")
    some = near.alike(p, ["y", "x", "f"], lambda q: near.aggregate(q, graph.radius_distance(p, 2.0, ("y", "x"), sources=q, carry=["f"]), p, ["f"], ["Min", "Median", "Sum", "Std"], "R"))
    got, want = ({(r["site"], r["id"]): [round(v, 9) for v in r[-4:]] for r in x.select(*every.columns).where("site is not null").collect()} for x in (some, every))
    assert got == want and some.count() == 120


#: Queries over edges, none of which may broadcast points or edges.
EDGE_QUERIES = ("g01_g13_neighbour_aggregates", "g06_neighbour_indices", "g06_neighbour_lists", "g10_quantile", "g14_weighted_circular", "g16_density", "g16_density_all", "g03_dense_aggregates", "x01_neighbour_function", "g02_edge_aggregates", "g04_weight_aggregates", "g11_mode", "g14_circular", "g15_weighted", "g17_gradient", "g19_local_asynchrony", "h13_stacked_edges", "h01_radius_adjacency", "h02_radius_distance", "h05_radius_kernel")


@pytest.mark.parametrize("name", EDGE_QUERIES)
def test_points_and_edges_are_joined_by_shuffle(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_nearest_neighbours_do_not_broadcast_exploded_points(spark, monkeypatch):
    plans = []
    write = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), write(df, label))[1])
    registry.queries()["h03_knn_adjacency"](spark, "/root/testdata/sf0.001")
    joins = [x for label, p in plans if label == "knn-found" for x in p.splitlines() if "Join" in x and "g_" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


@pytest.mark.parametrize("n", (1, 2, 3))
def test_walks_between_places_are_those_between_points(spark, n):
    """One, two, three and five points at a place, with places beyond each other's reach."""
    rows = [("s", 10 * i + j, 0.0, float(x)) for i, (x, k) in enumerate(((0, 1), (1, 2), (2, 3), (3, 1), (4, 5), (9, 1), (20, 2), (30, 3))) for j in range(k)]
    p = spark.createDataFrame(rows, "site string, id long, y double, x double")
    want = graph.n_step(graph.radius_distance(p, 1.0, ("y", "x")), n)
    got = graph.n_step_within(p, 1.0, n, ("y", "x"))
    assert sorted(map(tuple, got.select("src", "dst").collect())) == sorted(map(tuple, want.select("src", "dst").collect()))


def test_masked_shares_between_places(spark):
    """Shares of a pair of places hold for all their points, as samples counted one by one give them."""
    rows = [("s", i, 0.0, float(i % 4), float(i % 3 * 2)) for i in range(24)]
    p = spark.createDataFrame(rows, "site string, id long, z double, y double, x double")
    mask = spark.createDataFrame([("s", 0, y, x, 1) for y, x in ((0, 0), (1, 1), (2, 3), (3, 4))], "site string, z int, y int, x int, value int")
    inside = {(0, 0), (1, 1), (2, 3), (3, 4)}
    at = {r[1]: r[3:] for r in rows}
    half_up = lambda v: math.floor(v + 0.5)
    share = lambda a, b: sum(tuple(half_up(u + (v - u) * (i / 49)) for u, v in zip(a, b)) in inside for i in range(50)) / 50
    want = {(a, b): share(at[a], at[b]) for a in at for b in at if a != b and math.dist(at[a], at[b]) <= 3}
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.masked_share_within(p, 3.0, mask, axes=("y", "x")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_border_distances_of_a_roi_without_background(spark):
    """The query gives no rows where its SQL finds no background to measure to."""
    rows = [(roi, z, 0, 0, int(roi == "b" or z > 0)) for roi in "ab" for z in range(3)]
    v = spark.createDataFrame(rows, "roi string, z int, y int, x int, label int")
    got = registry.queries()["v07_border_distance_grown"].func(spark, "", volume=lambda *_: v)
    assert {tuple(r) for r in got.collect()} == {("a", z, 0, 0, float(z * z)) for z in range(3)}


def test_correlations_alone_shuffle_voxels_not_pairs(spark):
    """Pearson's coefficient needs sums alone; constant channels and single voxels have none, pairs without common voxels no row."""
    v = spark.createDataFrame([("s", 0, 0, x, 1 + (x == 5)) for x in range(6)], "roi string, z int, y int, x int, label int")
    values = [(c, x, f(x)) for c, f in (("a", lambda x: 1e9 + x), ("b", lambda x: float(x * x)), ("d", lambda x: 7.0)) for x in range(6)] + [("e", 5, 1.0)]
    images = spark.createDataFrame([("s", c, 0, 0, x, float(u)) for c, x, u in values], "roi string, c string, z int, y int, x int, value double")
    out = hoods.batch_correlations(v, images, keep=["PearsonR"])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["label"], r["c0"], r["c1"]): r["PearsonR"] for r in out.collect()}
    assert abs(got[(1, "a", "b")] - np.corrcoef([0, 1, 2, 3, 4], [0, 1, 4, 9, 16])[0, 1]) < 1e-9
    assert got[(1, "a", "d")] is None and got[(2, "a", "b")] is None and (1, "a", "e") not in got and (2, "a", "e") in got
