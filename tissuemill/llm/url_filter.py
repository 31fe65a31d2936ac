"""URL filters: curated host and path rules, and association rules mined from labelled URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuemill.llm._shared import durable, spread_join

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_BAD = "label=block"


def host_of(url: Column) -> Column:
    """Lower-cased host after the first ``://``; empty for null or without it."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Path after the host, up to ``?`` or ``#``; empty for null or without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(rest, F.lit(""))


def curated(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits; null fields if none does.

    A rule fits its host and its subdomains where the path starts with the rule's path;
    the longest is that with the most characters, then the first listed.
    """
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column) -> Column:
    """Different tokens of a URL: ``h:`` labels of the host and parts of those, ``p:`` parts of the path; numbers are left out."""
    labels = F.split(host, r"\.")
    parts = F.split(host, r"[.-]")
    pieces = F.split(F.lower(path), r"[/._-]")
    useful = lambda x: (x != "") & ~x.rlike("^[0-9]+$")
    named = lambda mark, xs: F.transform(F.filter(xs, useful), lambda x: F.concat(F.lit(mark), x))
    return F.array_sort(F.array_distinct(F.concat(named("h:", labels), named("h:", parts), named("p:", pieces))))


def _one_of_each(rows: DataFrame) -> DataFrame:
    """``tokens`` of ``rows(tokens, …)`` without those that stand in the same rows as a smaller token.

    Such tokens say the same; together they would make exponentially many item sets.
    Tokens of the same rows have the same count and sums of two row hashes.
    """
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "url-numbered")
    deal = lambda seed: F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)"))
    per = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), deal(1).alias("a"), deal(2).alias("b"))
    kept = per.groupBy("n", "a", "b").agg(F.min("token").alias("token")).select("token", "n")
    left = spread_join(rows.select("row", F.explode("tokens").alias("token")), durable(kept, "url-tokens"), "token", F.col("row"), rows.count())
    return rows.drop("tokens").join(left.groupBy("row").agg(F.array_sort(F.collect_list("token")).alias("tokens")), "row").drop("row")


def mine_rules(labelled: DataFrame, *, min_support: float = 0.005, min_rows: int = 10, min_confidence: float = 0.95, min_lift: float = 1.2) -> DataFrame:
    """Blocking rules ``(rule_id, tokens, confidence, support)`` from ``labelled(tokens, bad 0/1)``.

    FP-growth mines item sets of the tokens and of the label; rules that conclude the
    blocking label stay if they hold for ``min_support`` of the URLs, ``min_rows`` at
    least, and reach the confidence and lift, and if no shorter rule
    among their parts does (which would fire anyway). Of tokens that always stand
    together one stands for all. No labelled URL: no rules.
    """
    labelled = _one_of_each(labelled.select("tokens", "bad").where(F.size("tokens") > 0))
    items = durable(labelled.select(F.when(F.col("bad") == 1, F.concat("tokens", F.array(F.lit(_BAD)))).otherwise(F.col("tokens")).alias("items")), "url-items")
    schema = "rule_id long, tokens array<string>, confidence double, support double"
    n = items.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / n)), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.get("consequent", F.lit(0)) == _BAD) & (F.col("lift") >= min_lift) & (F.col("support") * n >= min_rows - 0.5))
    rules = durable(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").withColumn("rule_id", F.monotonically_increasing_id()), "url-rules")
    short = rules.select(F.col("rule_id").alias("short_id"), F.col("tokens").alias("short"), F.get("tokens", F.lit(0)).alias("t"))
    covered = rules.select("rule_id", "tokens", F.explode("tokens").alias("t")).join(short, "t").where(
        (F.size("short") < F.size("tokens")) & (F.size(F.array_except("short", "tokens")) == 0)).select("rule_id").distinct()
    return rules.join(covered, "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "support")


def match_rules(urls: DataFrame, rules: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Keys of ``urls(key, n, tokens)`` that some rule fits, with the best rule: ``(key, n, rule_tokens, confidence)``.

    The inverted index lists each rule once, under the token that the fewest URLs hold
    (``frequencies(token, n)``); a URL looks up its tokens and checks the rule's others.
    """
    rare = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token")).join(frequencies, "token")
    index = rare.groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("rarest"), F.first("tokens").alias("rule_tokens"), F.first("confidence").alias("confidence"))
    index = durable(index.groupBy("rarest.token").agg(F.max("rarest.n").alias("n"), F.collect_list(F.struct("confidence", "rule_tokens")).alias("rules")), "url-index")
    looked = urls.select("key", F.col("n").alias("times"), "tokens", F.explode("tokens").alias("token"))
    hits = spread_join(looked, index, "token", F.col("key"), urls.count())
    best = F.array_max(F.filter("rules", lambda r: F.size(F.array_except(r["rule_tokens"], F.col("tokens"))) == 0))
    hits = hits.select("key", "times", best.alias("r")).where("r is not null").groupBy("key").agg(F.max("times").alias("n"), F.max("r").alias("r"))
    return hits.select("key", "n", "r.rule_tokens", "r.confidence")


def judge_urls(pages: DataFrame, labels: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
               label_id: str = "doc_id", label_col: str = "quality", **options) -> DataFrame:
    """``(id, host, path, rule, verdict, mined)`` for each row of ``pages``.

    The longest curated rule decides where one fits. Elsewhere the mined rules do: they
    are learned from the URLs that no curated rule decides, labelled by
    ``labels`` of the document whose number the URL's path holds (0 is bad); a URL that
    fits a mined rule is blocked, ``mined`` naming its tokens; any other is allowed.
    Tokens are handled once per different host and path. Null URLs have empty host and
    path, fit nothing and are allowed; repeated rows get equal answers; an empty table gives no row. A long URL costs
    its length, and its tokens' item sets if it is labelled and many URLs share them. Of rules of equal confidence the
    one with the greater list of tokens counts.
    """
    # a path is empty or begins with the sign at which hosts end, so the two in a row tell them apart
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = durable(rows.withColumn("c", curated(F.col("host"), F.col("path"), rules)), "url-rows")
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]{1,18})(?:[/.]|$)', 1) as bigint)")
    known = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).alias("number")).agg(F.max((F.col(label_col) == 0).cast("int")).alias("bad"))
    open_ = rows.where("c.verdict is null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    open_ = durable(open_.withColumns({"tokens": tokens(F.col("host"), F.col("path")), "number": number, "key": F.concat("host", "path")}), "url-distinct")
    mined = mine_rules(open_.join(known, "number").select("tokens", "bad"), **options)
    frequencies = open_.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    hits = durable(match_rules(open_.select("key", "n", "tokens"), mined, frequencies).select("key", "n", "rule_tokens"), "url-hits")
    keyed = spread_join(rows.withColumn("key", F.concat("host", "path")), hits, "key", F.col("id"), rows.count(), "left")
    verdict = F.coalesce("c.verdict", F.when(F.col("rule_tokens").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return keyed.select("id", "host", "path", F.col("c.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("c.verdict").isNull(), F.array_join("rule_tokens", " ")).alias("mined"))
