"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuemill.llm._shared import durable, words

#: Plans of more sources, or with longer names in all, are joined by shuffle instead of broadcast.
_FEW, _NAME_BYTES = 200_000, 64_000_000


def word_count(text: Column) -> Column:
    """Number of words of a text as long, 0 for null."""
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target of each source from ``sizes(source, source_size, …)``.

    Sources in code-point order, null last, get the weights in turn and share
    ``share`` times all sizes; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight, until none is above. The fixed point of
    that is a water level: sorted by limit over weight, all sources before the first
    one that the level does not fill are at their limit. Both windows are over one
    row per source. Column added: ``target`` double.
    """
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", turn)
    by_fill = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    up_to = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    level = ranked.withColumns({
        "before": F.coalesce(F.sum("source_size").over(up_to), F.lit(0)),
        "w_left": F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(up_to), F.lit(0)),
        "total": F.sum("source_size").over(all_rows),
    })
    level = level.withColumn("level", (F.lit(share) * F.col("total") - F.lit(most) * F.col("before")) / F.col("w_left"))
    open_ = F.when(F.col("level") * F.col("w") < F.lit(most) * F.col("source_size"), F.struct((F.col("source_size") / F.col("w")).alias("f"), "rank", "level"))
    level = level.withColumn("level", F.min(open_).over(all_rows)["level"])
    limit = F.lit(most) * F.col("source_size")
    target = F.when(F.col("level").isNull(), limit).otherwise(F.least(limit, F.col("level") * F.col("w")))
    return level.select(*[F.col(f"`{c}`") for c in sizes.columns], target.cast("double").alias("target"))


def uniform(key: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key, the text and the seed alone: 52 bits of an MD5."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def inclusion_odds(size: Column) -> Column:
    """Odds with which a document is drawn, up to a factor that its source's target sets: the root of its size."""
    return F.sqrt(size.cast("double") + 1)


def _measure(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> Column:
    """Struct ``(id, source, size, q)`` of a row; ``q`` is its rank: random odds over inclusion odds."""
    size, u = word_count(F.col(text_col)), uniform(F.col(id_col), F.col(text_col), seed)
    return F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), ((u / (1 - u)) / inclusion_odds(size)).alias("q"))


def _with_sources(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """``rows(m struct, …)`` joined with ``plan(source, …)`` as column ``p``.

    One row per source is broadcast if the sources are few and their names short, which
    is checked; beyond that each plan row is copied for 64 parts of its source's rows.
    """
    n, size = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    each = plan.select(F.col("source").alias("plan_source"), F.struct(*plan.columns).alias("p"))
    if n <= _FEW and size <= _NAME_BYTES:
        return rows.join(F.broadcast(each), F.col("m.source").eqNullSafe(F.col("plan_source")), how).drop("plan_source")
    each = each.withColumn("plan_part", F.explode(F.sequence(F.lit(0), F.lit(63))))
    part = F.pmod(F.xxhash64(F.col("m.id"), F.col("m.q")), F.lit(64)).cast("int")
    return rows.join(each, F.col("m.source").eqNullSafe(F.col("plan_source")) & (part == F.col("plan_part")), how).drop("plan_source", "plan_part")


def _plan(measured: DataFrame, weights: Sequence[int], share: float, most: float, within: float, bucket_rows: int) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, ``whole`` copies of all and the ``cuts`` of those drawn beyond.

    ``cuts`` lists ``(left, q, id)``: a document is drawn if for some cut its size is at
    most ``left`` and its ``(q, id)`` at most the cut's.
    """
    per = durable(measured.groupBy(F.col("m.source").alias("source")).agg(F.sum("m.size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    n_buckets = max(16, -(-(per.agg(F.max("n")).first()[0] or 0) // bucket_rows))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = source_targets(per, weights, share, most).withColumns({"whole": F.floor(ratio).cast("long"), "left": (ratio - F.floor(ratio)) * F.col("source_size")})
    cut = f"struct<left:double,q:double,id:{measured.schema['m'].dataType['id'].dataType.simpleString()}>"
    plan = goal.withColumns({"middle": inclusion_odds(F.col("source_size") / F.col("n")), "cuts": F.array().cast(f"array<{cut}>"), "open": F.col("left") > F.lit(within) * F.col("target")})
    plan = durable(plan, "mix-plan")
    while not plan.where("open").isEmpty():
        plan = _one_round(measured, plan, within, n_buckets)
    return plan


def _one_round(measured: DataFrame, plan: DataFrame, within: float, n_buckets: int) -> DataFrame:
    """Cuts further on: the next documents by rank that fit what is left of their source's words, up to the first that overshoots.

    Sums per bucket of ranks give the one bucket in which a source's limit falls, and
    only that bucket is sorted.
    """
    last = F.get("p.cuts", F.size("p.cuts") - 1)
    here = F.struct(F.col("m.q").alias("q"), F.col("m.id").alias("id"))
    later = last.isNull() | (here > F.struct(last["q"].alias("q"), last["id"].alias("id")))
    fitting = _with_sources(measured, plan.where("open")).where((F.col("m.size") <= F.col("p.left")) & (F.col("m.size") > 0) & later)
    scaled = F.col("m.q") * F.col("p.middle")
    bucket = F.least(F.floor(scaled / (1 + scaled) * n_buckets), F.lit(n_buckets - 1)).cast("int")
    fitting = fitting.select("m.*", F.col("p.left").alias("left"), bucket.alias("bucket"))
    sums = fitting.groupBy("source", "left", "bucket").agg(F.sum("size").alias("s"), F.max(F.struct("q", "id")).alias("top"), F.min(F.struct("q", "id")).alias("least"))
    sums = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("source").orderBy("bucket")))
    step = F.struct("bucket", (F.col("upto") - F.col("s")).alias("base"))
    edge = sums.groupBy("source").agg(
        F.min(F.when(F.col("upto") > F.col("left"), step)).alias("edge"), F.max(F.when(F.col("upto") <= F.col("left"), F.struct("upto", "top"))).alias("full"), F.min("least").alias("least"))
    edge = durable(edge, "mix-edges")
    at = _with_sources(fitting.select(F.struct("source", "size", "q", "id").alias("m"), "left", "bucket"), edge.where("edge is not null")).where(F.col("bucket") == F.col("p.edge.bucket"))
    run = at.select("m.*", "left", (F.col("p.edge.base") + F.sum("m.size").over(Window.partitionBy("m.source").orderBy("m.q", "m.id"))).alias("run"))
    inside = run.where("run <= left").groupBy("source").agg(F.max(F.struct(F.col("run").alias("upto"), F.struct("q", "id").alias("top"))).alias("full"))
    # without an edge all that fit are drawn and nothing is left to draw; copies of one rank that overshoot together are passed over
    found = edge.select("source", "full", "least", F.col("edge").isNotNull().alias("more")).unionByName(inside.withColumn("more", F.lit(True)), allowMissingColumns=True)
    found = found.groupBy("source").agg(F.max("full").alias("full"), F.max("more").alias("more"), F.max("least").alias("least"))
    out = plan.join(found.withColumnRenamed("source", "found_source"), F.col("source").eqNullSafe(F.col("found_source")), "left")
    end = F.coalesce("full.top", "least")
    entry = F.named_struct(F.lit("left"), F.when(F.col("full").isNotNull(), F.col("left")).otherwise(F.lit(-1.0)), F.lit("q"), end["q"], F.lit("id"), end["id"])
    out = out.withColumn("cuts", F.when(end.isNotNull(), F.concat("cuts", F.array(entry))).otherwise(F.col("cuts"))).withColumn("left", F.col("left") - F.coalesce(F.col("full.upto"), F.lit(0)))
    out = out.withColumn("open", F.col("open") & F.coalesce("more", F.lit(False)) & (F.col("left") > F.lit(within) * F.col("target")))
    return durable(out.select(*plan.columns), "mix-plan")


def _copies() -> Column:
    here = F.struct(F.col("m.q").alias("q"), F.col("m.id").alias("id"))
    drawn = F.exists("p.cuts", lambda c: (F.col("m.size") <= c["left"]) & (here <= F.struct(c["q"].alias("q"), c["id"].alias("id"))))
    return F.col("p.whole") + (drawn & (F.col("m.size") > 0)).cast("long")


def plan_mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, within: float = 0.001, bucket_rows: int = 50_000,
) -> DataFrame:
    """How many copies of each document a mix takes.

    A source with target ``t`` and size ``s`` gives every document ``floor(t/s)``
    certain copies. The words that are left are drawn by Pareto order sampling with
    unequal inclusion odds, which grow with the root of a document's size: documents
    are ranked by their random odds ``u/(1-u)`` over the inclusion odds (a common factor
    of a source's odds changes no rank), and the lowest ranks are taken until the words
    left for the source are used up. The sample's size is thus fixed, in words. A
    document that would overshoot is passed over and later ones that still fit are
    taken, until less than ``within`` of the target is left or none fits.

    Ranks are cut into buckets, whose sums give the one bucket in which a source's
    limit falls, and only that bucket is sorted: no source is ever in one task.

    Returns one row per input row with ``id``, ``source``, ``size`` long,
    ``source_size`` long, ``target`` double, ``copies`` long, ``taken`` long. Null text
    has size 0; null sources are one source; rows with equal id and text are taken or left
    together; an empty table gives no rows. A long text costs its length, twice.
    """
    measured = durable(docs.select(_measure(docs, id_col, text_col, source_col, seed).alias("m")), "mix-sizes")
    planned = _with_sources(measured, _plan(measured, weights, share, most, within, bucket_rows))
    return planned.select("m.id", "m.source", "m.size", "p.source_size", "p.target", _copies().alias("copies"), (_copies() * F.col("m.size")).alias("taken"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, within: float = 0.001, bucket_rows: int = 50_000,
) -> DataFrame:
    """The mixed documents, columns unchanged: each row of ``docs`` as often as :func:`plan_mix` says.

    Whether a document is drawn follows from its own rank and its source's plan, so
    texts are not shuffled. Rows that are taken no time are left out.
    """
    measured = durable(docs.select(_measure(docs, id_col, text_col, source_col, seed).alias("m")), "mix-sizes")
    plan = _plan(measured, weights, share, most, within, bucket_rows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _measure(docs, id_col, text_col, source_col, seed).alias("m"))
    out = _with_sources(rows, plan).select("row", F.explode(F.array_repeat(F.lit(1), _copies().cast("int"))).alias("copy"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
