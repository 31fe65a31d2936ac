"""Every operator and stage on nulls, empty tables, repeated rows and ids, ties, very long texts, and clashing column names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tissuemill.llm import knn_quality, metric_join, mixing, near_copies, packing, pii, quality_rules, sentence_spans, simhash, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Names that operators use inside, and some that only begin like them.
CLASH = ["id", "_id", "s", "f", "spans", "base_spans", "_copies", "_copy", "_n", "_spans", "fp", "component", "seq", "ids", "row", "text_hash", "hot_key", "spread", "is_hot", "quality_stats", "m", "p", "q", "kept", "rule", "own_hash",
         "kept_id", "kept_hash", "span_id", "extra", "row_id", "row_text", "plan_source", "copy", "key", "n", "last", "digest", "host", "path"]

#: Each takes documents and gives documents.
STAGES = {
    "quality rules": lambda d, labels: quality_rules.filter_quality(d, labels), "simhash": lambda d, _: simhash.drop_near_duplicates(d), "near copies": lambda d, _: near_copies.drop_near_copies(d),
    "personal data": lambda d, _: pii.redact(d), "mixing": lambda d, _: mixing.mix(d), "sentence spans": lambda d, _: sentence_spans.remove_spans(d),
}


def text(i, n=40):
    return " ".join(f"w{(i * 31 + k * k) % 4999}" for k in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, text(i), "en", f"s{i % 3}", len(text(i))) for i in range(40)]
    out += [(1, text(1), "en", "s1", 1), (1, text(1), "en", "s1", 1), (1, text(77), "en", "s2", 1), (None, text(2), None, None, None), (None, text(2), None, None, None), (None, text(88), None, "s0", None)]
    return out + [(200, None, None, None, None), (201, "", "", "", 0), (202, " ".join(f"x{k}" for k in range(150_000)), "en", "s0", 1), (203, "x@y.org " * 3000, "en", "s0", 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1), (3, 1, 0)], LABELS)


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, rows, labels, name):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})
    out = STAGES[name](docs, labels).collect()
    assert out and all(list(r.asDict()) == docs.columns and [r[c] for c in CLASH] == list(range(len(CLASH))) for r in out[:3] + out[-3:])
    ids = [r["doc_id"] for r in out]
    texts = {(r["doc_id"], r["text"]) for r in out}
    if name == "quality rules":
        assert not {200, 201} & set(ids) and 202 in ids and ids.count(1) == 4
    elif name in ("simhash", "near copies"):
        # copies are one row, unlike texts under one id all stay, an unnamed copy goes before a named one
        assert ids.count(1) == 2 and (1, text(77)) in texts and (None, text(2)) not in texts and (None, text(88)) in texts and 202 in ids
    elif name == "personal data":
        assert len(out) == len(rows) and (203, "[EMAIL] " * 3000) in texts and (200, None) in texts
    elif name == "mixing":
        assert {i for i in ids if i} <= {r[0] for r in rows} and max(ids.count(i) for i in (5, 6, 202)) <= 2
    else:
        assert len(out) == len(rows) and (1, text(77)) in texts


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_nothing(spark, labels, name):
    none = spark.createDataFrame([], DOCS)
    out = STAGES[name](none, labels.limit(0))
    assert out.columns == none.columns and out.count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_of_the_other_operators(spark, rows, labels):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in CLASH if c not in ("id",)})
    assert packing.pack(docs, TOKENIZER).select("doc_id").where("doc_id is null").count() >= 3
    assert mixing.plan_mix(docs).count() == len(rows) and mixing.plan_mix(docs.withColumn("source", F.lit(None).cast("string"))).where("taken > 2 * size").count() == 0
    scored = knn_quality.score(docs, knn_quality.fit(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert simhash.near_duplicates(docs).count() == len(rows) and sentence_spans.repeated_spans(docs).count() == len(rows)


def test_pages(spark):
    pages = spark.createDataFrame([(5, "http://a.com/x", "same"), (5, "http://b.com/y", "same"), (7, "http://a.com/x", "same"), (None, None, "same"), (8, "nope", None)], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit(1) for c in CLASH})
    got = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert got == [(0, "revisit", 7), (5, "revisit", 7), (5, "revisit", 7), (7, "response", None), (8, "response", None)]
    judged = url_filter.judge_urls(pages, spark.createDataFrame([], LABELS)).collect()
    assert len(judged) == 5 and {r["verdict"] for r in judged} == {"allow"}


def test_hot_url_and_payload(spark):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("http://casino.example.com/a").alias("url"), F.lit("same").alias("html"))
    assert {(r["record_type"], r["refers_to"], r["count"]) for r in warc.round_trip(pages).groupBy("record_type", "refers_to").count().collect()} == {("revisit", 3999, 3999), ("response", None, 1)}
    assert url_filter.judge_urls(pages, spark.createDataFrame([], LABELS)).where("verdict = 'allow'").count() == 4000


def test_hot_vector_and_fingerprint(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0] if i % 2 else rng.normal(size=3).tolist()) for i in range(3000)]
    got = metric_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("id % 2 = 1").select("component").distinct().count()
    assert got == 1
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, F.lit(text(1))).otherwise(F.concat_ws(" ", *[F.xxhash64("id", F.lit(k)).cast("string") for k in range(12)])).alias("text"))
    assert simhash.near_duplicates(docs).where("id % 2 = 1 and component = 1").count() == 1500


def test_ties_of_neighbours_and_rules(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad bad bad", None, None, 1) for i in range(60)], DOCS)
    model = knn_quality.fit(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS))
    scores = {(r["id"] % 2, r["score"] >= 0.5) for r in knn_quality.score(docs, model).collect()}
    assert scores == {(0, False), (1, True)}
    judged = packing.pack(docs, TOKENIZER)
    assert judged.count() == 60 and judged.select("sequence_id", "offset").distinct().count() == 60


def test_blocked_votes_equal_plain_ones():
    rng = np.random.default_rng(6)
    n = knn_quality.N_TERMS
    terms = (rng.random((300, n)) < 0.02) * rng.random((300, n)).astype(np.float32)
    model = knn_quality.Model(np.ones(n, np.float32), rng.normal(size=(n, 16)).astype(np.float32), np.zeros((0, 16), np.float32), rng.integers(0, 2, 120).astype(float), 0.5)
    model = knn_quality.Model(model.weights, model.projection, model.latent(terms[:120].astype(np.float32)), model.labels, 0.5)
    got = model.score(terms.astype(np.float32), k=9, block=64)
    near = np.maximum(model.latent(terms.astype(np.float32)) @ model.vectors.T, 0)
    for i in range(300):
        best = sorted(range(120), key=lambda j: -near[i, j])[:9]
        w = near[i, best].astype(float) ** 4
        assert abs(got[i] - (w @ model.labels[best] / w.sum() if w.sum() else 0.5)) < 1e-6
