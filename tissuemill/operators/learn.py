"""Labels, splits, pipelines, prediction and importance."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tissuemill.functions.durable import durable
from tissuemill.operators import ranked
from tissuemill.operators.reshape import c
from tissuemill.operators.windows import random_order


def mapped(column: Column, mapping: dict, default: Column | None = None) -> Column:
    """Values by a dictionary, others the default."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), F.lit(None) if default is None else default)


def granularities(df: DataFrame, column: str, maps: dict[str, dict]) -> DataFrame:
    """For each map of codes to classes, from fine to coarse, a column of its name with the class, and ``{name}int`` with the class's place among the map's classes, where it first stands; codes that a map lacks keep themselves as text and have no place."""
    out = df
    for name, classes in maps.items():
        values = list(classes.values())
        named = mapped(c(column), classes, c(column).cast("string"))
        out = out.withColumns({name: named, f"{name}int": mapped(named, {v: values.index(v) for v in dict.fromkeys(values)})})
    return out


def flagged(sources: Sequence[tuple[DataFrame, str, int]], keys: Sequence[str], name: str = "is_debris") -> DataFrame:
    """``(keys, name)`` of annotations of several sources ``(table, column, code)`` put together: whether a row's code is the one that its source means by it."""
    from functools import reduce

    parts = [t.select(*[c(k) for k in keys], (c(column) == code).alias(name)) for t, column, code in sources]
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_ordinals(df: DataFrame, column: str, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Column ``name``: 0-based place of a row's value among the different values, by where each first occurs in the order."""
    seen = df.where(c(column).isNotNull()).groupBy(c(column).alias("_value")).agg(F.min(F.struct(*[c(o) for o in order])).alias("_first"))
    places = ranked.numbered(seen, ["_first"], name).select("_value", name)
    return df.join(places, c(column) == F.col("_value"), "left").drop("_value")


def train_test_split(df: DataFrame, label: str, share: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Column ``is_train``: of each class, ``round(n · share)`` rows in a pseudo-random order of the keys.

    The order's value at that rank is found per class and joined; rows with equal keys go together.
    """
    rows = df.withColumn("_order", random_order(keys, seed))
    cut = ranked.values_at(rows, [label], "_order", {"_cut": F.round(F.col("all") * F.lit(share)) - 1}).select(c(label).alias("_class"), "_cut")
    out = rows.join(cut, c(label).eqNullSafe(F.col("_class")), "left")
    return out.withColumn("is_train", F.coalesce(F.col("_order") <= F.col("_cut"), F.lit(False))).drop("_order", "_class", "_cut")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Column ``weight``: rows over classes times the class's rows; counts are joined."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    every = per.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(per.crossJoin(F.broadcast(every)), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def forest_pipeline(columns: Sequence[str], label: str = "label", components: int | None = None, trees: int = 20, depth: int = 5, seed: int = 42) -> Pipeline:
    """Median imputer, scaler, optional principal components, weighted random forest."""
    filled = [f"{x}__filled" for x in columns]
    stages = [Imputer(inputCols=list(columns), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"),
              StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]
    if components:
        stages.append(PCA(k=components, inputCol="scaled", outputCol="reduced"))
    stages.append(RandomForestClassifier(featuresCol="reduced" if components else "scaled", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed))
    return Pipeline(stages=stages)


def grid_search(pipeline: Pipeline, train: DataFrame, depths: Sequence[int], label: str = "label", folds: int = 3, seed: int = 42) -> tuple[PipelineModel, list[tuple[int, float]]]:
    """Best pipeline by cross-validated accuracy, and the mean score of each depth."""
    forest = pipeline.getStages()[-1]
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).build()
    scorer = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    model = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=scorer, numFolds=folds, seed=seed).fit(train)
    return model.bestModel, list(zip(depths, model.avgMetrics))


def forest_search(train: DataFrame, columns: Sequence[str], keys: Sequence[str], label: str = "label", *, trees: Sequence[int] = (20,), components: Sequence[int | None] = (None,), depths: Sequence[int] = (5,), folds: int = 3, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """The pipeline with the best mean accuracy over folds, fit on all rows, and ``(trees, components, depth, fold, n, score)`` of every combination and fold.

    A row's fold is a hash of its keys, so reruns agree; each fold is written once, and all combinations are scored on it.
    Ties go to the combination given first.
    """
    fold = F.pmod(F.xxhash64(F.lit(seed), *[c(k) for k in keys]), F.lit(folds)).cast("int")
    rows = durable(train.withColumn("_fold", fold), "search-folds")
    table, settings = [], [(t, k, d) for t in trees for k in components for d in depths]
    for f in range(folds):
        rest, held = rows.where(F.col("_fold") != f), rows.where(F.col("_fold") == f)
        for t, k, d in settings:
            scored = forest_pipeline(columns, label, k, t, d, seed).fit(rest).transform(held)
            hit = scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == c(label)).cast("double")).alias("score")).first()
            table.append((t, k, d, f, hit["n"], hit["score"]))
    mean = {s: np.mean([r[5] for r in table if r[:3] == s and r[5] is not None]) for s in settings}
    t, k, d = max(settings, key=lambda s: mean[s])
    schema = "trees int, components int, depth int, fold int, n long, score double"
    return forest_pipeline(columns, label, k, t, d, seed).fit(rows.drop("_fold")), train.sparkSession.createDataFrame(table, schema)


def predictions(model: PipelineModel, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, pred, probas)``."""
    return model.transform(df).select(*keys, F.col("prediction").cast("int").alias("pred"), vector_to_array("probability").alias("probas"))


def uncorrelated(df: DataFrame, columns: Sequence[str], threshold: float = 0.95, method: str = "pearson") -> list[str]:
    """Columns left when each that correlates with an earlier kept one above the threshold is dropped."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v", handleInvalid="skip").transform(df.select(*[c(x) for x in columns]))
    m = Correlation.corr(vectors, "_v", method).first()[0].toArray()
    kept: list[int] = []
    for i in range(len(columns)):
        if all(abs(m[i, k]) <= threshold for k in kept):
            kept.append(i)
    return [columns[i] for i in kept]


def impurity_importance(model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """Each column's impurity importance, and its deviation, standard error and quartiles over trees."""
    from pyspark.sql import SparkSession

    forest, spark = model.stages[-1], SparkSession.active()
    per = np.array([t.featureImportances.toArray() for t in forest.trees])
    low, mid, high = np.quantile(per, (0.25, 0.5, 0.75), axis=0)
    sd = per.std(axis=0)
    rows = [(x, *(float(v) for v in (forest.featureImportances[i], sd[i], sd[i] / len(per) ** 0.5, low[i], mid[i], high[i]))) for i, x in enumerate(columns)]
    return spark.createDataFrame(rows, "feature string, importance double, std double, sem double, q25 double, median double, q75 double")


def permutation_importance(model: PipelineModel, df: DataFrame, columns: Sequence[str], keys: Sequence[str], label: str = "label", repeats: int = 3, seed: int = 42) -> DataFrame:
    """``(feature, importance, deviation)``: the accuracy less the mean accuracy, over repeats, when a column is dealt anew among the rows.

    Rows are numbered once in a pseudo-random order; repeat ``r`` (from 1) gives each row the values of the one
    ``r / (repeats + 1)`` of all rows further on. One join brings them to every repeat, one
    transform scores all columns and repeats stacked, and one aggregate counts.
    """
    names = list(dict.fromkeys([*columns, label]))
    rows = durable(ranked.numbered(df, [random_order(keys, seed), *keys]).select("_row", *[c(x) for x in model_inputs(model, names, df)]), "permutation-rows")
    n = rows.count()
    given = rows.withColumn("_repeat", F.explode(F.array(*[F.lit(r) for r in range(1, repeats + 1)])))
    given = given.withColumn("_at", (F.col("_row") + F.floor(F.col("_repeat") * F.lit(n) / (repeats + 1))) % F.lit(max(n, 1)))
    dealt = rows.select(F.col("_row").alias("_at"), F.struct(*[c(x) for x in columns]).alias("_dealt"))
    which = F.explode(F.array(F.lit(None).cast("int"), *[F.lit(i) for i in range(len(columns))]))
    stacked = given.join(dealt, "_at").withColumn("_which", which)
    stacked = stacked.withColumns({x: F.when(F.col("_which") == i, F.col("_dealt")[x]).otherwise(c(x)) for i, x in enumerate(columns)})
    hits = model.transform(stacked).groupBy("_which", "_repeat").agg(F.avg((F.col("prediction") == c(label)).cast("double")).alias("score"))
    per = hits.groupBy("_which").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"))
    base = per.where("_which is null").select(F.col("mean").alias("base"))
    feature = F.get(F.array(*[F.lit(x) for x in columns]), F.col("_which"))
    return per.where("_which is not null").crossJoin(F.broadcast(base)).select(feature.alias("feature"), (F.col("base") - F.col("mean")).alias("importance"), "deviation")


def model_inputs(model: PipelineModel, names: Sequence[str], df: DataFrame) -> list[str]:
    """The columns of ``df`` that a fitted pipeline reads, after ``names``."""
    read = [x for stage in model.stages if stage.hasParam("inputCols") for x in stage.getInputCols()]
    return list(dict.fromkeys([*names, *[x for x in read if x in df.columns]]))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """``(label, pred, n)``."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """True and false positive rates at each different score, by running totals over counts per score."""
    per = df.groupBy(c(score).alias("score")).agg(F.sum(c(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    every = per.agg(F.sum("p").alias("all_p"), F.sum(F.col("n") - F.col("p")).alias("all_n"))
    down = ranked.running(per, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n") - F.col("p")})
    return down.crossJoin(F.broadcast(every)).select("score", (F.col("tp") / F.col("all_p")).alias("tpr"), (F.col("fp") / F.col("all_n")).alias("fpr"))


def training_set(annotations: DataFrame, features: DataFrame, keys: Sequence[str], columns: Sequence[str], share: float = 0.01, correlation: str = "_PearsonR|_SpearmanR|_KendallTau") -> DataFrame:
    """Annotated rows with features fit to learn from: NaN is null; columns with over ``share`` nulls over non-nulls go, nulls of correlations are 0, and rows with a null left go."""
    from tissuemill.functions import names
    from tissuemill.operators import clean

    joined = clean.nan_to_null(annotations.join(features, list(keys)), names.of_type(features, T.DoubleType, T.FloatType))
    kept = clean.drop_null_columns(joined, columns, "perc", share)
    left = [x for x in columns if x in kept.columns]
    zero = [x for x in left if re.search(correlation, x)]
    return clean.drop_null_rows(kept.withColumns({x: F.coalesce(c(x), F.lit(0.0)) for x in zero}), left)


def rekeyed(annotations: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Annotations of the rows that a new feature set has, keys cast to its types."""
    cast = annotations.withColumns({k: c(k).cast(features.schema[k].dataType) for k in keys})
    return cast.join(features.select(*keys), list(keys), "left_semi")


def tracking_table(frames: dict[int, DataFrame], renames: dict[str, str]) -> DataFrame:
    """Frames' features under new names with their time point ``t``, united."""
    from functools import reduce

    parts = [f.select(*[c(a).alias(b) for a, b in renames.items()], F.lit(t).alias("t")) for t, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def parameter_sweep(spark, **values: Sequence) -> DataFrame:
    """Every combination of the given parameter values, one row each."""
    one = spark.range(1)
    for name, xs in values.items():
        one = one.withColumn(name, F.explode(F.array(*[F.lit(x) for x in xs])))
    return one.drop("id")
