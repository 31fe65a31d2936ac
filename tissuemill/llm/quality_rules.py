"""Quality rules: a decision list learned by sequential covering, as Spark expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuemill.llm._shared import BLANKS, durable, fresh, let, words

#: Statistics that rules may test; all are doubles in [0, inf), none depends on ids, source or language.
FEATURES = ("n_words", "word_length", "symbol_share", "upper_share", "bang_share", "dup_line_share", "repeat_share", "stutter_share")

NGRAM = 5


def _covered(hashes: Column) -> Column:
    """Positions in windows whose hash occurs twice or more, for an array of window hashes."""
    def both_sides(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(ordered, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, k + 1)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["i"]))

    def joined(starts: Column) -> Column:
        step = F.transform(starts, lambda v, j: F.coalesce(F.least(F.get(starts, j + 1) - v, F.lit(NGRAM)), F.lit(NGRAM)))
        return F.aggregate(step, F.lit(0), lambda acc, x: acc + x)

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return let(let(F.sort_array(pairs), both_sides), joined)


def text_statistics(text: Column) -> Column:
    """Struct of whole-text counts: long fields, all 0 for null and empty texts.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_upper``,
    ``n_bangs``, ``n_stutter`` (words equal to the next one), ``n_lines`` and ``n_dup_lines``
    (lines with a word; those equal to an earlier one), ``n_repeat_words`` (words in
    five-word windows that the text has twice or more, the first included). Windows are
    compared by 64-bit hash; only a text whose windows repeat is sorted.
    """
    text = F.coalesce(text, F.lit(""))
    removed = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def of(w: Column) -> Column:
        ahead = lambda i: [F.get(w, i + k) for k in range(1, NGRAM)]
        windows = F.when(F.size(w) < NGRAM, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (NGRAM - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *ahead(i))))
        repeats = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1))).cast("long").alias("n_stutter"), repeats.cast("long").alias("n_repeat_words"),
        )

    counted = let(words(text), of)
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    both = let(F.struct(counted.alias("w"), line_counts.alias("l")), lambda s: F.struct(
        s["w"]["n_words"].alias("n_words"), s["w"]["word_chars"].alias("word_chars"), removed(r"[#*$%&|<>]").alias("n_symbols"),
        removed(r"\P{Lu}+").alias("_not_upper"), (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        F.length(text).cast("long").alias("_chars"), s["w"]["n_stutter"].alias("n_stutter"), s["l"]["n_lines"].alias("n_lines"),
        s["l"]["n_dup_lines"].alias("n_dup_lines"), s["w"]["n_repeat_words"].alias("n_repeat_words")))
    return let(both, lambda s: F.struct(*[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_bangs", "n_stutter", "n_lines", "n_dup_lines", "n_repeat_words")], (s["_chars"] - s["_not_upper"]).alias("n_upper")))


def features(stats: Column) -> Column:
    """Struct of :data:`FEATURES` from a struct of :func:`text_statistics`."""
    over = lambda a, b: F.when(stats[b] > 0, stats[a] / stats[b]).otherwise(F.lit(0.0))
    value = {
        "n_words": stats["n_words"].cast("double"), "word_length": over("word_chars", "n_words"), "symbol_share": over("n_symbols", "word_chars"),
        "upper_share": over("n_upper", "word_chars"), "bang_share": over("n_bangs", "word_chars"), "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"), "stutter_share": over("n_stutter", "n_words"),
    }
    return F.struct(*[value[f].alias(f) for f in FEATURES])


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold``, or ``feature < threshold``."""

    feature: str
    at_least: bool
    threshold: float

    def column(self, of: Column) -> Column:
        return of[self.feature] >= self.threshold if self.at_least else of[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with its counts of bad and good texts on the pruning fold."""

    conditions: tuple[Condition, ...]
    bad: int = 0
    good: int = 0

    def column(self, of: Column) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(of)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class RuleList:
    """Ordered rules; the first one that holds rejects a text."""

    rules: list[Rule] = field(default_factory=list)

    def fired(self, of: Column) -> Column:
        """The first rule that holds, as a conditional expression; null if none does."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(rule.column(of), F.lit(str(rule))).otherwise(out)
        return out


def learn_rules(
    labelled: DataFrame, *, n_cuts: int = 64, max_rules: int = 12, max_conditions: int = 3, min_bad: int = 2, bad_share: float = 0.02, min_precision: float = 0.98,
) -> RuleList:
    """Learn a rule list from ``labelled(id, bad 0/1, f struct)`` by sequential covering.

    Two thirds of the rows, by a hash of the id, grow rules and one third prunes them.
    A rule grows by the condition with the largest FOIL gain among each feature's quantiles
    in either class, loses trailing conditions that do not help on the pruning rows, and is
    kept if there it holds for ``bad_share`` of the bad texts, ``min_bad`` at least, with
    ``min_precision``. Rows it covers are then left out. Every count is one grouped aggregate over all labelled
    rows; the driver sees only a table of features times cuts. ``max_rules`` and
    ``max_conditions`` bound the length of the list and of a rule, ``n_cuts`` the thresholds that are tried per feature
    and class; rows are never left out. Of conditions of equal gain the first feature's lowest cut counts. No labels, or none
    that are bad: no rules.
    """
    cuts_of = F.array(*[F.lit(i / n_cuts) for i in range(1, n_cuts)])
    quantiles = labelled.groupBy("bad").agg(*[F.percentile_approx(F.col("f")[f], cuts_of, F.lit(10_000)).alias(f) for f in FEATURES]).collect()
    cuts = {f: sorted({c for row in quantiles for c in row[f]}) for f in FEATURES}
    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[f]]), lambda c: c <= F.col("f")[f])) if cuts[f] else F.lit(0)

    bins = F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(f).alias("bin")) for f in FEATURES])
    binned = labelled.select("bad", (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("prune"), "f", bins.alias("bins"))
    rows = durable(binned, "rule-rows")
    needed = max(min_bad, math.ceil(bad_share * (rows.where("prune").agg(F.sum("bad")).first()[0] or 0)))
    out = RuleList()
    for _ in range(max_rules):
        open_ = rows.where(F.coalesce(~_any(out.rules), F.lit(True)))
        conditions: list[Condition] = []
        while len(conditions) < max_conditions:
            best = _best_condition(open_.where(~F.col("prune") & Rule(tuple(conditions)).column(F.col("f"))), cuts)
            if best is None:
                break
            conditions.append(best[0])
            if best[1] == 0:
                break
        if not conditions:
            break
        rule = _pruned(open_.where("prune"), conditions)
        if rule.bad < needed or rule.bad < min_precision * (rule.bad + rule.good):
            break
        out.rules.append(rule)
    return out


def _any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | rule.column(F.col("f"))
    return out


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, int] | None:
    """The condition with the largest FOIL gain over ``rows`` and the good texts left in it."""
    table = rows.select("bad", F.explode("bins").alias("b")).groupBy("b.feature", "b.bin").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    best, found = 1e-9, None
    for f in FEATURES:
        bad, good = [0] * (len(cuts[f]) + 1), [0] * (len(cuts[f]) + 1)
        for r in table:
            if r["feature"] == f:
                bad[r["bin"]], good[r["bin"]] = r["bad"], r["n"] - r["bad"]
        p0, n0 = sum(bad), sum(good)
        if not p0 or not n0:
            return None
        for k, cut in enumerate(cuts[f]):
            for at_least, p, n in ((True, sum(bad[k + 1 :]), sum(good[k + 1 :])), (False, sum(bad[: k + 1]), sum(good[: k + 1]))):
                if p and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > best:
                    best, found = gain, (Condition(f, at_least, float(cut)), n)
    return found


def _pruned(rows: DataFrame, conditions: list[Condition]) -> Rule:
    """The shortest leading part of ``conditions`` with the best ``(bad - good) / (bad + good)``."""
    parts = [Rule(tuple(conditions[: k + 1])) for k in range(len(conditions))]
    counts = rows.agg(*[F.sum(F.when(r.column(F.col("f")), c)).alias(f"{name}{k}") for k, r in enumerate(parts) for name, c in (("bad", F.col("bad")), ("good", 1 - F.col("bad")))]).first()
    scored = [Rule(r.conditions, int(counts[f"bad{k}"] or 0), int(counts[f"good{k}"] or 0)) for k, r in enumerate(parts)]
    return max(scored, key=lambda r: ((r.bad - r.good) / max(1, r.bad + r.good), -len(r.conditions)))


def base_failed(stats: Column) -> Column:
    """Fewer than 10 words, or over 20 % of the words in repeated five-word windows."""
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def labelled_features(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", stats_col: str = "s") -> DataFrame:
    """Training rows ``(id, bad, f)`` from ``stats(id_col, stats_col struct)`` and a label table.

    Label 0 is bad; an id with several labels is bad if any is; null ids and null
    labels teach nothing, nor do texts that the base rule rejects anyway.
    """
    bad = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 0).cast("int")).alias("bad"))
    kept = stats.where(~base_failed(F.col(stats_col)))
    return kept.select(F.col(id_col).alias("id"), features(F.col(stats_col)).alias("f")).join(bad, "id")


def judge(stats: DataFrame, rules: RuleList) -> DataFrame:
    """Add ``base_failed``, ``rule`` (the one that rejects, else null) and ``kept`` to ``stats(…, s struct)``."""
    fired = rules.fired(F.col("f"))
    return stats.withColumn("f", features(F.col("s"))).withColumns({"base_failed": base_failed(F.col("s")), "rule": fired}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()).drop("f")


def filter_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """The documents that the base rule and the learned list keep, columns unchanged.

    Statistics are computed once and written beside the documents, which are not
    shuffled; what is joined with the labels holds ids and counts alone. Null and empty texts
    have no words and go; a long text costs its length, and sorting its windows if one
    repeats. An empty label table leaves the base rule.
    """
    (name,) = fresh(docs.columns, "quality_stats")
    with_stats = durable(docs.withColumn(name, text_statistics(F.col(text_col))), "quality-stats")
    rules = learn_rules(durable(labelled_features(with_stats, labels, id_col=id_col, label_col=label_col, stats_col=name), "rule-train"), **options)
    kept = ~base_failed(F.col(name)) & rules.fired(features(F.col(name))).isNull()
    return with_stats.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
