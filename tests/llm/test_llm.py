"""Edge cases and brute-force comparisons of the training-data operators."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tissuemill.llm import knn_quality, metric_join, mixing, packing, pii, quality_rules, sentence_spans, simhash, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "a b c", "x " * 5000, "same words here and there\nsame words here and there", "Ünï çödé ☃ " * 3, "9" * 3000, "." * 2000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None if i % 2 else f"s{i % 3}", None) for i, t in enumerate(ODD)] + [(3, "one", "en", "s0", 3), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_statistics(odd):
    got = odd.select("text", quality_rules.text_statistics(F.col("text")).alias("s")).select("text", "s.*").collect()
    for r in got:
        w = WORDS.findall(r["text"] or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(grams)
        covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))


def test_rules_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.filter_quality(odd, labels).columns == odd.columns


def test_rules_learn(spark):
    # texts that the base rule keeps, as only those teach
    rows = [(i, " ".join(f"n{k}" + ("!!" if i % 4 == 0 else "") for k in range(12 + i % 5)) + " " + " ".join(f"w{i}{k}" for k in range(40)), "en", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)], "doc_id long, quality int")
    stats = docs.select("doc_id", quality_rules.text_statistics(F.col("text")).alias("s"))
    rules = quality_rules.learn_rules(quality_rules.labelled_features(stats, labels))
    judged = {r["doc_id"]: r["rule"] is None for r in quality_rules.judge(stats, rules).collect()}
    assert sum(judged[i] == (i % 4 != 0) for i in judged) >= 190


def test_simhash(spark, odd, empty):
    base = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    near = base.replace("word5 ", "other ", 1)
    docs = odd.union(spark.createDataFrame([(50, base, "", "", 0), (51, near, "", "", 0), (52, base, "", "", 0)], DOCS))
    got = simhash.near_duplicates(docs).collect()
    prints = [(r["id"], r["fp"], r["component"]) for r in got]
    by = {f for _, f, _ in prints}
    root = {f: f for f in by}
    for _ in by:
        for a in by:
            for b in by:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    low = collections.defaultdict(list)
    for i, f, _ in prints:
        if i is not None:
            low[root[f]].append(i)
    assert all(c == (min(low[root[f]]) if low[root[f]] else None) for _, f, c in prints)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(docs).where("doc_id in (50, 51, 52)").count() == 1


def test_links_are_found_once(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**63), 2**63 - 1, 200)
    b = np.array([int(x) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 7), False)) for x in a])
    v = sorted({int(x) for x in np.concatenate((a, b))})
    want = {(x, y) for i, x in enumerate(v) for y in v[i + 1 :] if 1 <= bin((x ^ y) & (2**64 - 1)).count("1") <= 4}
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in v], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_mixing(spark, odd, empty):
    rows = [(i, "w " * (i % 40 + 1), "en", ("a", "b", "c", None)[i % 4], 1) for i in range(400)]
    got = mixing.plan_mix(spark.createDataFrame(rows, DOCS)).collect()
    per = collections.defaultdict(int)
    for r in got:
        per[r["source"], r["target"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(n - t) <= 0.02 * t + 1 for (_, t), n in per.items())
    assert mixing.plan_mix(odd).count() == odd.count() and mixing.plan_mix(empty).count() == 0
    assert mixing.mix(odd).columns == odd.columns


def test_pii(spark, odd, empty):
    text = "mail a.b@c-d.org, ip 10.0.0.255 or 1.2.3.999; card 4111 1111 1111 1111 and 4111 1111 1111 1112; call +1 (504) 555-2652."
    docs = spark.createDataFrame([(1, text, "", "", len(text))], DOCS).union(odd)
    got = pii.find(docs).where("doc_id = 1 and n_chars > 10").select(pii.listed(F.col("spans")).alias("s")).first()["s"]
    assert [x.split(":")[0] for x in got.split(",")] == ["email", "ip", "card", "phone"]
    assert pii.redact(docs).where(F.contains("text", F.lit("[EMAIL]")) & F.contains("text", F.lit("[PHONE]."))).count() == 1
    assert pii.find(empty).count() == 0


def test_pii_learns_from_contexts(spark):
    def card(i):
        body = f"4111 1111 1111 1{i:02d}"
        digits = [int(c) for c in body if c.isdigit()][::-1]
        total = sum(d if k % 2 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits))
        return body + str(-total % 10)

    rows = [(i, f"hello there card no {card(i) if i < 30 else '1234 5678 9012 3456'} thanks", "", "", 0) for i in range(33)]
    got = pii.find(spark.createDataFrame(rows, DOCS)).where("doc_id >= 30").select(F.size("spans").alias("n"), F.size("base_spans").alias("b")).collect()
    assert all(r["b"] == 0 and r["n"] == 1 for r in got)


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc(version):
    records = [warc.ArcRecord({"url": f"http://a/{i}", "ip": "1.1.1.1", "date": "20010203040506", "type": "text/html"}, b"HTTP/1.0 200 OK\r\n\r\n" + p) for i, p in enumerate((b"", b"x\n\nhttp://fake 1 2 3 4\n", "é".encode() * 99))]
    got = list(warc.parse_arc(warc.arc_bytes(records, version)))
    assert [g.content for g in got[1:]] == [r.content for r in records]
    fields, block = next(warc.parse_warc(warc.convert(got[1]) + b"\r\n\r\n"))
    assert fields["WARC-Date"] == "2001-02-03T04:05:06Z" and fields["WARC-Type"] == "response" and block == records[0].content
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_bytes(records, version)[:-5]))


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a b/", "same\r\n\r\nx"), (2, None, "same\r\n\r\nx"), (3, "http://c", None), (4, "http://d", ""), (5, "u", "é" * 9), (None, "u", "lone")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_sha1_ok"]) for r in warc.round_trip(pages).collect()}
    assert got == {1: (9, "revisit", 2, True), 2: (9, "response", None, True), 3: (0, "revisit", 4, True), 4: (0, "response", None, True), 5: (18, "response", None, True), None: (4, "response", None, True)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_url_filter(spark):
    rows = [(i, f"http://{'casino-x' if i % 2 else 'fine'}.example.org/p/{i}") for i in range(60)] + [(100, None), (101, "nope"), (102, "ftp://WWW.Example.NET/en/1?x"), (103, "x://a.net"), (104, "x://a.net/z#f"), (105, "x://b.org/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(0, 40)], "doc_id long, quality int")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, labels).collect()}
    assert got[100] == got[101] == ("", "", None, "allow")
    assert got[102] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[103][:3] == ("a.net", "", None) and got[104][2:] == ("net/", "block") and got[105][2:] == ("org/fr/", "allow")
    assert got[59][3] == "block" and got[58][3] == "allow"
    none = url_filter.judge_urls(pages.limit(0), labels)
    assert none.count() == 0


def test_sentence_spans(spark, odd, empty):
    shared = "The quick brown fox jumps over the lazy dog again. It was seen by many people in the old town, and none of them spoke. Then the rain came down."
    docs = spark.createDataFrame([(1, "Alpha beta. " + shared + " End one.", "", "", 0), (2, "Other start here and " + shared + " Tail.", "", "", 0), (3, "Nothing in common at all.", "", "", 0)], DOCS)
    got = {r["id"]: r for r in sentence_spans.repeated_spans(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] >= 3 and got[3]["n_removed"] == 0
    kept = {r["doc_id"]: r["text"] for r in sentence_spans.remove_spans(docs).collect()}
    assert "old town" in kept[1] and "old town" not in kept[2] and kept[2].endswith("Tail.")
    assert sentence_spans.repeated_spans(odd).count() == odd.count() and sentence_spans.repeated_spans(empty).count() == 0


def test_metric_join(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 16))
    x[60:100] = x[:40] + rng.normal(size=(40, 16)) * 0.15
    x[100:110] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["id"]: r for r in metric_join.near_duplicates(df, per_cell=10, block=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    comp = np.arange(120)
    for _ in range(120):
        comp = np.array([comp[h].min() for h in hit])
    assert [got[i]["n_links"] for i in range(120)] == (hit.sum(1) - 1).tolist()
    assert [got[i]["component"] for i in range(120)] == comp.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (200, 201, 202, 203, 204))
    assert metric_join.near_duplicates(df.limit(0)).count() == 0


def test_packing(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(i, " ".join(f"word{i * k % 97}" for k in range(1, 20 + i * 7 % 900)), "", "", 0) for i in range(150)] + [(900, "it's <|endoftext|> ΑΣ\tx", "", "", 0), (901, None, "", "", 0), (902, "", "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = packing.pack(docs, path, shard_docs=40).toPandas()
    for i, t, *_ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        g = got[got.doc_id == i].sort_values("start")
        assert g.length.sum() == len(ids) and (g.start == g.length.cumsum() - g.length).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(g.start, g.length)] == g.ids_crc32.tolist()
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.offset == g.groupby("sequence_id").length.cumsum() - g.length).all() and g.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(odd, path).count() >= odd.count() and packing.pack(empty, path).count() == 0


def test_bm25_matches_plain_formula():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 30, rng.integers(5, 60)).astype("<u2") for _ in range(25)]
    idf = rng.random(40)
    shard = packing.Shard(docs, idf, 64)
    mean = np.mean([len(d) for d in docs])
    for s in (0, 7):
        want = [sum(idf[t] * (f := (d == t).sum()) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in np.unique(docs[s])) for d in docs]
        assert np.allclose(shard.scores(s), want)


def test_quality_vote(spark, odd, empty):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda i: " ".join(rng.choice(vocab, 60)) if i % 3 else (str(rng.choice(vocab)) + "!! ").upper() * 60
    docs = spark.createDataFrame([(i, text(i), "", "", 0) for i in range(300)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    model = knn_quality.fit(docs, labels)
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    got = {r["id"]: r["score"] for r in knn_quality.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.95
    assert knn_quality.score(odd, model).where("score between 0 and 1").count() == odd.count() and knn_quality.score(empty, model).count() == 0
    assert knn_quality.score(docs.limit(3), knn_quality.fit(docs, labels.limit(0))).where("score = 0.5").count() == 3


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, "Clean words " + " ".join(f"w{(i * 31 + k * k) % 5000}" for k in range(80)) + (" mail me@x.org" if i == 5 else ""), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, rows[1][1], "en", "s1", 1), (101, "few words", "en", "s1", 1), (102, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        seen.append({r["doc_id"] for r in docs.collect()})
    assert seen[0] == set(range(60)) | {100} and seen[1] == set(range(60)) == seen[2]
    assert corpus_pipeline.run(spark, d).count() >= len(seen[3])


def test_word_ids_equal_the_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [
        "", None, "  a  b\n\nC", "It's don't 'sx ab' ab's x_y_ ___ a_ A.B,c...", "İstanbul ΣΣ ΟΔΟΣ ẞ ǅ Å ﬁn naïve## 12ab ab12 ½ Ⅷ \U0001d400 \U0001f600a",
        "<|endoftext|> a<|startoftext|>b <|endoftext|>, END<|", "a\tb\rc\x0bd\x85e f　h \x00 \x1c", "가 é ʰ ªº µ ſ K", "word word. word, Word### WORD|",
        "été, ÉTÉ! ×. ÷, a÷. Ã· à·! naïve's ñ) ÿ] …! é… q\u0301, <\u0338 a=\u0338", "a.b.c d_e. f_, g'll h'S i's, (j) k;l", "\n\nx,\n", ",", "é",
    ]
    tokenizer, known = Tokenizer.from_file(path), packing.WordIds(path, "<u2", most=5)
    assert known.bulk
    for _ in range(2):
        for i in range(len(texts)):
            got = [np.frombuffer(x, "<u2").tolist() for x in known.ids(pa.array(texts, pa.string()).slice(i, 2)).to_pylist()]
            assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[i : i + 2]]


def _card(i):
    body = f"4111 1111 1111 1{i:02d}"
    digits = [int(c) for c in body if c.isdigit()][::-1]
    return body + str(-sum(d if k % 2 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits)) % 10)


def test_pii_in_lists_and_beside_base_spans(spark):
    unseen = ["1234 5678 9012 3456", "2345 6789 0123 4568", "3456 7890 1234 5679", "9876 5432 1098 7654"]
    rows = [(i, f"hello there card no {_card(i)} thanks", "", "", 0) for i in range(40)]
    rows += [(50, "all: " + " ".join(unseen) + " end", "", "", 0), (51, f"mail me@x.org {unseen[0]} there", "", "", 0), (52, "none 12 345 here", "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).where("doc_id >= 50").collect()}
    assert got == {50: "all: " + " ".join(["[CARD]"] * 4) + " end", 51: "mail [EMAIL] [CARD] there", 52: "none 12 345 here"}


def test_spans_of_texts_without_marks(spark):
    words = [f"w{i * 7919 % 1009}" for i in range(120)]
    text, passage = " ".join(words[:60]), " ".join(words[60:])
    rows = [(1, text), (2, text), (3, f"before this {passage} follows that"), (4, f"elsewhere stands {passage} and more"), (5, "一 二 三。" * 9), (6, "一 二 三。" * 9), (7, "lone"), (8, "lone")]
    got = {r["id"]: r for r in sentence_spans.repeated_spans(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)).collect()}
    assert all(got[i]["n_removed"] == 0 for i in (1, 3, 7))
    assert all(got[i]["n_removed"] == got[i]["n_sentences"] for i in (2, 6, 8))
    assert sum(s["end"] - s["start"] for s in got[4]["spans"]) > len(passage) / 2


def test_pipeline_drops_near_copies(spark, odd, empty):
    base = [f"word{i * 7919 % 1000}" for i in range(400)]
    def changed(every, start=0):
        return " ".join(f"new{i}" if i % every == start else w for i, w in enumerate(base))
    def similarity(a, b):
        a, b = ({tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in (a, b))
        return len(a & b) / len(a | b)
    near, far = changed(80, 7), changed(12)
    assert similarity(" ".join(base), near) >= 0.8 > similarity(" ".join(base), far)
    rows = [(1, " ".join(base)), (2, near), (3, far), (4, " ".join(base).upper()), (5, "one text"), (5, "another text"), (None, "one text"), (None, "unnamed"), (None, "unnamed")]
    rows += [(100 + i, changed(400, i)) for i in range(90)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(0, "unnamed"), (1, rows[0][1]), (3, far), (5, "one text"), (5, "another text")])
    assert corpus_pipeline.drop_near_duplicates(spark, empty, "").count() == 0
