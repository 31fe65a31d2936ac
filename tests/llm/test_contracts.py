"""The operators against brute-force versions of what they compute, on small tables."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tissuemill.llm import metric_join, mixing, near_copies, pii, quality_rules, queries, sentence_spans, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# The base patterns of personal data.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def tables(spark, folder, **rows):
    """Parquet tables of the given rows and schemas, as the registered queries read them."""
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def docs_of(texts):
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(name, m[0])]
    return [(n, s, e) for s, _, e, n in sorted(found)]


def test_base_spans(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", "\U0001f600 a@b.c 1.2.3.4\n4111 1111 1111 1111\n2024 was", "a@b.c" * 40, "1.2.3.4.5.6.7.8", "+1 (504) 555-2652 +1(2).3-4 5 6 7 8 9 0"]
    texts += ["".join(rng.choice("0123456789.@-+ ()ab\n%") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    texts += ["".join(rng.choice("01 -") for _ in range(400)) for _ in range(40)]
    d = tables(spark, tmp_path, documents=(docs_of(texts), DOCS))
    for r in queries.op4_pii(spark, d).collect():
        spans = base(texts[r["doc_id"]])
        listed = ",".join(f"{n}:{s}:{e}" for n, s, e in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(n == k for n, _, _ in spans) for k in PLAIN]
        assert {f"{n}:{s}:{e}" for n, s, e in spans} <= set(r["spans"].split(","))


def luhn(body):
    digits = [int(c) for c in body if c.isdigit()][::-1]
    return body + str(-sum(d if k % 2 else 2 * d - 9 * (d > 4) for k, d in enumerate(digits)) % 10)


def test_contexts_find_unseen_identifiers(spark):
    """Account numbers and tokens of other forms, told by the words beside them alone; look-alikes elsewhere stay."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda: " ".join(word() for _ in range(30))
    rows, unseen, alike = [], {}, {}
    for i in range(600):
        text, kind = prose(), i % 8
        if kind in (0, 3, 6):
            rows.append((i, f'{text} pay with {luhn("4" + "".join(rng.choice("0123456789") for _ in range(14)))} {prose()}'))
        elif kind in (1, 4, 7):
            rows.append((i, f'{text} secret key: "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}" {prose()}'))
        elif kind == 2:
            unseen[i] = "".join(rng.choice("0123456789") for _ in range(8)) if i % 16 == 2 else "-".join(f"{rng.randrange(16**4):04x}9" for _ in range(3))
            rows.append((i, f"{text} {'pay with' if i % 16 == 2 else 'secret key:'} {unseen[i]} {prose()}"))
        else:
            alike[i] = "".join(rng.choice("0123456789") for _ in range(8))
            rows.append((i, f"{text} {word()} {alike[i]} {prose()}"))
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s not in r["base_spans"]] for r in got}
    assert np.mean([unseen[i] in hit[i] for i in unseen]) >= 0.9
    assert np.mean([not hit[i] for i in alike]) >= 0.95


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@m.org says {i}" for i in range(20_000))
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), chars_col=None).first()["text"]
    assert out.count("[EMAIL]") == 20_000 and "@" not in out


def test_base_of_quality_rules(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", "a\na\n \na", "x " * 5000, "#*$%&|<> " * 4] + [rng.choice(" \n").join(rng.choice(["a", "bb", "c#", "é|", "\n", "a\n", "!!"]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    d = tables(spark, tmp_path, documents=(docs_of(texts), DOCS), labels=([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int"))
    for r in queries.op1_quality_rules(spark, d).collect():
        t = texts[r["doc_id"]] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(grams)
        repeat = len({p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)})
        failed = len(w) < 10 or 100 * repeat > 20 * len(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, failed)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (r["kept"] and failed)


def all_runs(texts, least, words):
    """Sentences that lie under any run that is not its first place, by enumerating every run of every length."""
    found = [sentence_spans.sentences(t or "") for t in texts]
    places = collections.defaultdict(list)
    for d, s in enumerate(found):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                size = sum(x[2].count(" ") + 1 for x in s[i:j])
                if (j - i >= least and size >= words) or (i == 0 and j == len(s)):
                    places[tuple(x[2] for x in s[i:j])].append((d, i, j, j - i >= least and size >= words))
    gone = [set() for _ in texts]
    for at in places.values():
        for d, i, j, _ in sorted(at)[1:]:
            gone[d] |= set(range(i, j))
    return found, gone


def test_spans_equal_runs_of_every_length(spark):
    rng = random.Random(7)
    pool = [" ".join(rng.choice("abcdefghij") for _ in range(rng.choice((1, 2, 4, 9, 20)))) + rng.choice(".!?") for _ in range(14)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(60)] + [None, "", "lone", "lone", " . . "]
    found, gone = all_runs(texts, 2, 8)
    got = {r["id"]: r for r in sentence_spans.repeated_spans(spark.createDataFrame(docs_of(texts), DOCS), least=2, words=8).collect()}
    for d, t in enumerate(texts):
        kept = [k for k in range(len(found[d])) if k not in gone[d]]
        assert got[d]["n_removed"] == len(gone[d]), (d, t)
        inside = [any(s["start"] <= found[d][k][0] < s["end"] for s in got[d]["spans"]) for k in range(len(found[d]))]
        assert [k for k, x in enumerate(inside) if not x] == kept


def test_removal_goes_by_text(spark):
    copy = "One two three four five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen sixteen."
    other = "Unrelated words that have as many letters as the other text has".ljust(len(copy), "x")
    rows = [(1, copy), (5, copy), (5, other), (None, copy), (None, other[::-1])]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in sentence_spans.remove_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted([(1, copy), (5, ""), (5, other), (0, ""), (0, other[::-1])])


def test_frequent_runs_take_their_own_way(spark):
    shared = "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu xi omicron pi rho."
    rows = [(i, f"{shared} text{i} stands alone here.", "", "", 0) for i in range(3000)]
    got = sentence_spans.repeated_spans(spark.createDataFrame(rows, DOCS)).select("id", "n_removed").collect()
    assert sorted(r["id"] for r in got if not r["n_removed"]) == [0]


def brute_links(x, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in x]
    n, link = len(x), [set() for _ in x]
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]):
                c = math.fsum(a * b for a, b in zip(x[i], x[j])) / math.sqrt(math.fsum(a * a for a in x[i]) * math.fsum(b * b for b in x[j]))
                if c >= threshold:
                    link[i].add(j)
                    link[j].add(i)
    return link


def test_links_at_the_threshold_and_equal_ids(spark):
    rng = np.random.default_rng(3)
    turn = lambda c: [c, math.sqrt(1 - c * c), 0.0]
    x = [[1.0, 0.0, 0.0], turn(0.95), turn(0.95 - 5e-13), turn(0.95 + 5e-13), turn(-0.2)]
    x += [[1.0, 0.0], [2.0, 0.0], [1e200, 1e200, 0.0], [1e-200, 1e-200, 0.0], None, [], [0.0, 0.0, 0.0], [None, 1.0, 1.0]]
    x += [v.tolist() for v in rng.normal(size=(60, 3))]
    ids = list(range(len(x)))
    ids[1] = ids[4] = 4
    ids[20] = ids[21] = 50
    link = brute_links([None if v is None else [c / (max(map(abs, v)) or 1) if None not in v else c for c in v] for v in x])
    got = collections.Counter((r["id"], r["n_links"]) for r in metric_join.near_duplicates(spark.createDataFrame(list(zip(ids, x)), "vec_id long, embedding array<double>"), per_cell=8, block=8).collect())
    assert got == collections.Counter((i, len(s)) for i, s in zip(ids, link))


def test_inclusion_follows_the_odds(spark):
    """One source per draw, all with the same sizes: how often a size is drawn is its odds' share."""
    sizes = [4, 9, 16, 36, 64, 100] * 60
    rows = [(s * 1000 + i, "w " * n, "en", f"s{s:03}", 0) for s in range(30) for i, n in enumerate(sizes)]
    got = mixing.plan_mix(spark.createDataFrame(rows, DOCS), weights=(1,), share=0.5).groupBy("size").agg(F.avg("copies").alias("p")).collect()
    seen = {r["size"]: r["p"] for r in got}
    low, high = 1e-6, 1e6
    for _ in range(200):
        mid = math.sqrt(low * high)
        words = sum(n * mid * math.sqrt(n + 1) / (1 + mid * math.sqrt(n + 1)) for n in sizes)
        low, high = (mid, high) if words < 0.5 * sum(sizes) else (low, mid)
    for n in set(sizes):
        assert abs(seen[n] - low * math.sqrt(n + 1) / (1 + low * math.sqrt(n + 1))) < 0.05, (n, seen)
    assert seen[4] < seen[16] < seen[64]


def test_targets_by_resharing(spark):
    rng = random.Random(11)
    sizes = [(None if i == 5 else f"s{i:02}", rng.choice((0, 1, 5, 80, 1000, 20_000))) for i in range(23)]
    weights = (3, 1, 2)
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long"), weights).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = {s: weights[i % 3] for i, (s, _) in enumerate(order)}
    target, size, fixed = {}, dict(sizes), set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in fixed)
        for s in size:
            target[s] = 2 * size[s] if s in fixed else left * w[s] / max(1, sum(w[x] for x in size if x not in fixed))
        above = {s for s in size if s not in fixed and target[s] > 2 * size[s]}
        if not above:
            break
        fixed |= above
    assert all(abs(got[s] - target[s]) <= 1e-6 * max(1, target[s]) for s in size)


def test_rules_are_those_enumeration_finds(spark):
    rng = random.Random(5)
    names = [f"t{k}" for k in range(7)]
    rows = []
    for _ in range(300):
        tokens = sorted(rng.sample(names, rng.randint(1, 4)))
        rows.append((tokens, int(("t1" in tokens and "t2" in tokens) or ("t5" in tokens and rng.random() < 0.97))))
    got = {tuple(r["tokens"]) for r in url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad int")).collect()}
    want, share = set(), sum(b for _, b in rows) / len(rows)
    for k in range(1, 5):
        for items in itertools.combinations(names, k):
            hit = [b for t, b in rows if set(items) <= set(t)]
            enough = sum(hit) >= max(0.005 * len(rows), 10) and sum(hit) >= 0.95 * len(hit) and sum(hit) / len(hit) >= 1.2 * share
            if enough and not any(set(w) <= set(items) for w in want):
                want.add(items)
    assert got == want and ("t1", "t2") in got


def test_conjunctions_are_grown(spark):
    """Bad texts are those that both shout and repeat words; either alone is good."""
    rows = []
    for i in range(1200):
        shout, stutter = i % 2, i // 2 % 2
        words = [f"{'W' if shout and k % 2 else 'w'}{(i * 31 + k * k) % 997:03}" for k in range(40)]
        rows.append((i, " ".join(f"{w} {w}" if stutter and k % 3 == 0 else w for k, w in enumerate(words))))
    stats = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", quality_rules.text_statistics(F.col("text")).alias("s"))
    labels = spark.createDataFrame([(i, int(not (i % 2 and i // 2 % 2))) for i in range(1200)], "doc_id long, quality int")
    rules = quality_rules.learn_rules(quality_rules.labelled_features(stats, labels).cache())
    assert any(len(r.conditions) == 2 for r in rules.rules)
    judged = quality_rules.judge(stats, rules).select("doc_id", "rule").collect()
    assert np.mean([(r["rule"] is not None) == bool(r["doc_id"] % 2 and r["doc_id"] // 2 % 2) for r in judged]) > 0.98


def test_arc_files_of_any_bytes(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    bodies = [bytes(range(256)), b"\xff\xfe\r\n\r\nx", b"", "é".encode("latin-1") * 1000]
    records = [warc.ArcRecord({"url": f"http://a/{i}", "ip": "1.1.1.1", "date": "20010203040506", "type": "text/html"}, b"HTTP/1.0 200 OK\r\n\r\n" + x) for i, x in enumerate(bodies)]
    (tmp_path / "arc" / "one.arc").write_bytes(warc.arc_bytes(records))
    warc.convert_arc_files(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), records_per_file=2)
    got = {r["url"]: r for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert {u: r["payload_bytes"] for u, r in got.items()} == {f"http://a/{i}": len(x) for i, x in enumerate(bodies)}
    assert all(r["payload_sha1_ok"] and r["payload_digest"] == warc.sha1_base32(bodies[int(u[-1])]) for u, r in got.items())
    files = [f.read_bytes() for f in (tmp_path / "warc").glob("part-*")]
    assert len(files) >= 2 and all(sum(bool(m) for m in warc.members(f)) <= 2 for f in files)


def test_warc_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, None if i % 50 == 3 else f"http://h{i % 7}/p {i}%", rng.choice([None, "", "same", "ä" * 5, f"lone {i}"])) for i in range(200)]
    d = tables(spark, tmp_path, pages=(rows, "page_id long, url string, html string"))
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", i))
    for r in queries.op5_warc(spark, d).collect():
        h = (rows[r["page_id"]][2] or "").encode()
        to = last[h.decode()]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h), warc.sha1_base32(h))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if to == r["page_id"] else ("revisit", to))


def test_near_copies_by_all_pairs(spark):
    """Groups of near copies that meet in large buckets, among them chains whose ends are unlike, against all pairs."""
    rng = random.Random(12)
    texts = []
    for g in range(4):
        words = [f"g{g}w{k}" for k in range(120)]
        for _ in range(45):
            changed = list(words)
            for k in rng.sample(range(120), rng.choice((0, 1, 2, 4, 6))):
                changed[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(changed))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        before = list(root)
        for i in range(len(texts)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    got = {r["doc_id"] for r in near_copies.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=16).collect()}
    assert got == {i for i, r in enumerate(root) if i == r}


def test_near_copies_meet_in_deletion_variants(spark):
    """Links by variants connect what all pairs within both conditions connect, also where runs are dense and halves are cut."""
    rng = np.random.default_rng(8)
    width, usual, _ = near_copies.plan(0)
    prints = []
    for _ in range(12):
        base = rng.integers(0, 1 << 62, 120, dtype=np.uint64)
        for _ in range(rng.choice((1, 3, 70))):
            changed = base.copy()
            changed[: rng.choice((0, 2, 8, 20))] = rng.integers(0, 1 << 62)
            prints.append(near_copies._parts(np.unique(changed), width, usual, usual))
    parts = np.array(prints)
    apart = np.bitwise_count((parts[:, None] ^ parts[None]).view(np.uint64))
    near = (apart[:, :, : near_copies.SKETCH].sum(-1, dtype=int) <= near_copies.MOST) & (apart[:, :, near_copies.SKETCH :] <= 1).any(-1)

    def groups(pairs):
        root = list(range(len(parts)))
        for _ in root:
            before = list(root)
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                return root

    table = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "node long, parts array<long>")
    want = groups([(int(a), int(b)) for a, b in np.argwhere(near) if a < b])
    for block in (1 << 17, 20):
        got = [(r["a"], r["b"]) for r in near_copies.variant_links(table, width, task_rows=500, block=block).collect()]
        assert all(near[a, b] for a, b in got) and groups(got) == want


def test_near_copies_dense_group_gives_few_links(spark):
    """Near copies that meet in most segments, each time with others first, have few links a text, whatever the group's size."""
    rng = np.random.default_rng(21)
    width, usual, _ = near_copies.plan(0)
    base, prints = rng.integers(0, 1 << 62, 120, dtype=np.uint64), []
    for _ in range(600):
        changed = base.copy()
        changed[rng.choice(120, 5, replace=False)] = rng.integers(0, 1 << 62, 5)
        prints.append(near_copies._parts(np.unique(changed), width, usual, usual))
    nodes = rng.permutation(10**6)[:600].tolist()
    for n in (300, 600):
        table = spark.createDataFrame(list(zip(nodes[:n], prints)), "node long, parts array<long>")
        links = [(r["a"], r["b"]) for r in near_copies.variant_links(table, width, task_rows=500).collect()]
        group, grown = {min(nodes[:n])}, True
        while grown:
            more = {x for pair in links if not group.isdisjoint(pair) for x in pair} - group
            grown, group = bool(more), group | more
        assert group == set(nodes[:n]) and len(links) <= 20 * n


def test_near_copies_forest():
    """The pairs that stay are those that no lower ones connect, as Kruskal takes them one by one."""
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (2, 3), (30, 25), (30, 200), (500, 400), (500, 6000)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        root, want = list(range(n)), []
        for x, y in sorted({(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}):
            if root[x] != root[y]:
                root = [root[x] if r == root[y] else r for r in root]
                want.append((x, y))
        assert sorted((int(v) // n, int(v) % n) for v in near_copies._forest(a, b, n)) == want


def test_near_copies_recall_at_the_threshold():
    """Fingerprints of sets at a similarity of 0.8, few shingles and many, nearly always share a variant."""
    rng = np.random.default_rng(3)
    sizes = near_copies.plan(100_000)
    for common, own in ((4, (1, 0)), (12, (3, 0)), (80, (10, 10)), (400, (50, 50))):
        met = 0
        for _ in range(400):
            v = rng.integers(0, 1 << 63, common + sum(own), dtype=np.uint64) * np.uint64(2)
            a, b = near_copies._parts(v[: common + own[0]], *sizes), near_copies._parts(np.concatenate((v[:common], v[common + own[0] :])), *sizes)
            apart = [(x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) + (1 << 64)).bit_count() for x, y in zip(a, b)]
            met += sum(apart[: near_copies.SKETCH]) <= near_copies.MOST and min(apart[near_copies.SKETCH :]) <= 1
        assert met >= 0.985 * 400
