"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tissuemill.llm import knn_quality, main_text, metric_join, mixing, packing, pii, quality_rules, sentence_spans, simhash, spelling, url_filter, warc, word_runs
from tissuemill.llm._shared import durable, let, words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    stats = durable(docs.select("doc_id", quality_rules.text_statistics(F.col("text")).alias("s")), "rule-stats")
    rules = quality_rules.learn_rules(durable(quality_rules.labelled_features(stats, labels), "rule-train"))
    judged = quality_rules.judge(stats, rules)
    return judged.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", "base_failed", "kept", "rule")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    # hex() writes a negative number in two's complement
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_of = {f"n_{k}": _count_kind(i) for i, k in enumerate(pii.BASE)}
    return found.select("doc_id", *[c.alias(n) for n, c in n_of.items()], F.size("spans").cast("long").alias("n_spans"), F.sha2(pii.listed(F.col("base_spans")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def _count_kind(kind: int) -> Column:
    """Number of base spans of a kind."""
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return judged.withColumnRenamed("id", "page_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_spans.repeated_spans(_table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_chars", "n_sentences", "n_removed", removed.alias("removed_chars"), listed.alias("removed_spans"))


def op8_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metric_join.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = knn_quality.score(docs, knn_quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), (knn_quality.remainder(F.col("id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    # the url goes through beside the text, as a second row of a page may have another
    found = main_text.main_texts(pages, keep=["url"])
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def _with_planted_run(doc_id: Column, text: Column) -> Column:
    """The text with its words from some place on repeating, in one of ten documents."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def of(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))))

    chosen = (F.coalesce(h % 10, F.lit(1)) == 0) & (F.size(words(text)) > 0)
    return F.when(chosen, let(words(text), of)).otherwise(text)


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", _with_planted_run(F.col("doc_id"), F.col("text")).alias("text"))
    found = word_runs.periodic_runs(docs)
    # runs come by start, then period, so the first of equal exponent stays
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda acc, r: F.when(acc.isNull() | (r["length"] * acc["period"] > acc["length"] * r["period"]), r).otherwise(acc))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    rows = found.select("id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("r"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("r.length") / F.col("r.period"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_runs", "r.start", "r.length", "r.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _table(spark, sf_dir, "documents").select("doc_id", F.explode(spelling.letter_runs(F.col("text"))).alias("run"))
    runs = runs.where(F.char_length("run") >= 6).select("doc_id", spelling.lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    occurrences = runs.withColumn("h", h).select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.group_variants(spelling.vocabulary(occurrences))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_ROUND = """
o{k} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, id) AS run FROM r{j} WHERE NOT drawn AND size BETWEEN 1 AND left_ AND left_ > 0.001 * target),
u{k} AS (SELECT source, max(q) FILTER (WHERE run <= left_) AS cut, coalesce(max(run) FILTER (WHERE run <= left_), 0) AS used FROM o{k} GROUP BY source),
r{k} AS (SELECT r.* REPLACE (
    r.drawn OR coalesce(r.size BETWEEN 1 AND r.left_ AND r.q <= u.cut, false) AS drawn, r.left_ - coalesce(u.used, 0) AS left_)
  FROM r{j} r LEFT JOIN u{k} u ON r.source IS NOT DISTINCT FROM u.source),"""

#: Targets are reshared step by step until none is above its limit: each step fixes the sources that are.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS h FROM documents),
w AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
t(step, source, source_size, w, fixed, target) AS (
  SELECT 0, source, source_size, w, false, 0::DOUBLE FROM w
  UNION ALL
  SELECT step + 1, source, source_size, w, fixed OR share >= 2.0::DOUBLE * source_size, CASE WHEN fixed OR share >= 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size ELSE share END
  FROM (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) FILTER (WHERE fixed) OVER (), 0)) / sum(w) FILTER (WHERE NOT fixed) OVER () * w AS share FROM t)
  WHERE step < (SELECT count(*) FROM w) + 1),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t WHERE step = (SELECT max(step) FROM t)),
q AS (SELECT *, floor(ratio)::BIGINT AS whole, (ratio - floor(ratio)) * source_size AS left_ FROM p),
u AS (SELECT d.*, q.source_size, q.target, q.whole, q.left_, false AS drawn,
    (('0x' || substr(md5('17:' || coalesce(id::VARCHAR, '') || ':' || h), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
r0 AS (SELECT *, (u / (1.0::DOUBLE - u)) / sqrt(size::DOUBLE + 1) AS q FROM u),""" + "".join(_ROUND.format(k=k, j=k - 1) for k in range(1, 31)) + """
z AS (SELECT * FROM r30)
SELECT id AS doc_id, size, source_size, target, ((whole + drawn::INT) * size)::BIGINT AS taken FROM z"""


#: Base32 of a SHA-1 digest: each five hexadecimal digits are four of its digits.
_BASE32 = "list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr({x}, (5 * i + 1)::INT, 5))::BIGINT >> s) & 31) + 1)::INT, 1)), 'string_agg', '')), 'string_agg', '')"

OP5_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT *, strlen(h)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, upper({_BASE32.format(x="sha1(h)")}) AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d"""

#: Curated rules; in the given tables no rule is mined, so any other URL is allowed.
OP6_SQL = r"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT p.page_id, p.host, p.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY ALL)
SELECT page_id, host, path, rule, NULL::VARCHAR AS mined, coalesce(verdict, 'allow') AS verdict FROM m"""

OP8_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
c(node, low) AS (SELECT a, least(a, b) FROM l UNION SELECT l.b, c.low FROM c JOIN l ON l.a = c.node),
n AS (SELECT a, count(*) AS k FROM l GROUP BY 1), m AS (SELECT node, min(low) AS low FROM c GROUP BY 1)
SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept FROM v LEFT JOIN n ON vec_id = a LEFT JOIN m ON vec_id = node"""

#: CRC-32 by its table of 256 values, which the polynomial gives; near words meet at a code point left out.
OP13_SQL = r"""WITH RECURSIVE c(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
o AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT w, n, hex(encode(doc_id || ':' || w)) AS x FROM o WHERE length(w) >= 6),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)), lambda a, y: xor(a >> 8, t[(xor(a & 255, y) + 1)::INT])), 4294967295) AS h FROM b, crc),
a AS (SELECT CASE WHEN h % 199 = 0 THEN w[:(h % length(w))::INT] || w[(h % length(w))::INT + 2:] ELSE w END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1),
v AS (SELECT word, n FROM a WHERE length(word) >= 6 AND n >= 5),
d AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
e AS (SELECT DISTINCT x.word AS a, y.word AS b, y.n AS bn FROM d x JOIN d y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word UNION SELECT DISTINCT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT DISTINCT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
k AS (SELECT a AS word, count(*) AS n_near, max(bn) AS top, min(b) FILTER (WHERE bn = m) AS best FROM (SELECT *, max(bn) OVER (PARTITION BY a) AS m FROM e) GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN best END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n FROM v LEFT JOIN k ON v.word = k.word),
r(word, top_word, form) AS (SELECT word, word, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.form)
SELECT f.word, f.form, r.top_word AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_simhash_near_dedup, op3_mixing, op4_pii, op5_warc, op6_url_filter, op7_sentence_spans, op8_metric_join, op9_packing, op10_knn_quality, op11_main_text, op12_word_runs, op13_spelling_variants, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op5_warc": OP5_SQL, "op6_url_filter": OP6_SQL, "op8_metric_join": OP8_SQL, "op13_spelling_variants": OP13_SQL}
