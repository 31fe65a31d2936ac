"""Main text, periodic runs and spelling variants against plain versions of what they compute."""

import hashlib
import html
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuemill.llm import main_text, queries, simhash, spelling, warc, word_runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def tables(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


# periodic runs


def plain_runs(w):
    """Every run, by comparing all words at every distance."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i and not any(all(w[x] == w[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    rng = random.Random(1)
    for _ in range(1500):
        n, letters = rng.randint(0, 130), rng.choice([1, 2, 2, 3, 5, 50])
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n >= 8 else 0):
            p, s = rng.randint(1, n // 4), rng.randrange(n)
            for i in range(s + p, min(n, s + rng.randint(p, 6 * p))):
                w[i] = w[i - p]
        assert word_runs.runs_of(np.array(w, np.int64)) == plain_runs(w), w


def test_runs_inside_runs():
    w = [*([1, 1, 1, 1, 1, 1, 2] * 5), 3, *([4, 5] * 4), 3]
    assert word_runs.runs_of(np.array(w)) == [(0, 6, 1), (0, 35, 7), *[(7 * k, 6, 1) for k in range(1, 5)], (36, 8, 2)] == plain_runs(w)


def test_op12(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "x y x y", "\x0b".join("uv" * 6)]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    rows = [(i * 7, t, "en", "s0", 0) for i, t in enumerate(texts)] + [(7, "", None, None, None), (None, "b b b b b b b", None, None, None)]
    d = tables(spark, tmp_path, documents=(rows, DOCS))
    got = sorted((tuple(r) for r in queries.op12_word_runs(spark, d).collect()), key=str)
    want = []
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        drop = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{k},{q}\n" for s, k, q in runs), " ".join(x for i, x in enumerate(w) if i not in drop))]
        want.append((doc, n, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha))
    assert got == sorted(want, key=str) and sum(r[2] > 0 for r in want) > 5


def test_collapse_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c", 5, {"k": 1}), (1, "p  q", 6, None), (None, None, None, None)], "doc_id long, text string, whole int, collapsed map<string, int>")
    out = word_runs.collapse(docs)
    assert out.schema == docs.schema and sorted(map(str, out.collect())) == sorted(["Row(doc_id=1, text='a b c', whole=5, collapsed={'k': 1})", "Row(doc_id=1, text='p  q', whole=6, collapsed=None)", "Row(doc_id=None, text=None, whole=None, collapsed=None)"])
    assert word_runs.collapse(docs.limit(0)).count() == word_runs.periodic_runs(docs.limit(0)).count() == 0


def test_long_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "z " * 300_000, "ab " * 50_000 + "c")], "doc_id long, text string, other string")
    (r,) = word_runs.periodic_runs(docs).collect()
    assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (300_000, [(0, 300_000, 1)], "z")


# spelling variants


def near(u, v):
    if len(u) < len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def plain_variants(counts):
    near_of = {w: [v for v in counts if near(v, w)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near_of.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= 5 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near_of[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def test_composition_accepts_near_pairs():
    rng = random.Random(2)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 70))})
        got = sorted(tuple(sorted(p)) for p in spelling.one_edit_pairs(spelling.acceptor(words)))
        assert got == [(u, v) for i, u in enumerate(words) for v in words[i + 1 :] if near(u, v)]


def test_acceptor_is_minimal():
    a = spelling.acceptor(sorted(x + y for x in "abc" for y in ("tap", "taps", "top", "tops")))
    states, todo = {}, [a]
    while todo:
        s = todo.pop()
        states[id(s)] = s
        todo += s[1].values()
    # one state each for: start, t, a|o, p, s, end
    assert len(states) == 6


@pytest.mark.parametrize("most", [1000, 4])
def test_variants_of_crowded_words(spark, most):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(6, 8))) for _ in range(300)}
    words |= {"prefix" + "".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 4))) for _ in range(200)} | {"".join(rng.choice("abé") for _ in range(rng.randint(0, 4))) + "suffix" for _ in range(200)}
    counts = {w: rng.choice([5, 6, 30, 30, 200, 1200, 7000]) for w in sorted(words)}
    got = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), most=most).collect()
    assert {tuple(r) for r in got} == plain_variants(counts) and len(got) == len(counts)
    assert any(r["root"] not in (r["word"], r["form"]) for r in got)


def test_op13(spark, tmp_path):
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    texts = [None, "", "12 34", "ÀÉÎabc×÷ " * 6, "z" * 5000 + " short " * 9] + [" ".join(rng.choice([s, s.upper(), s.title()] * 9 + [s + "s", s[1:]]) for s in rng.choices(stems, k=200)) + "-" + rng.choice(stems) for _ in range(120)]
    rows = [(i, t, "en", "s0", 0) for i, t in enumerate(texts)] + [(3, "abcdef " * 5, None, None, None), (None, "abcdeg " * 3 + "ABCDEG abcdeg", None, None, None)]
    d = tables(spark, tmp_path, documents=(rows, DOCS))
    counts, lower = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] = counts.get(run, 0) + 1
    got = queries.op13_spelling_variants(spark, d).collect()
    assert {tuple(r) for r in got} == plain_variants({w: n for w, n in counts.items() if n >= 5}) and any(r["form"] for r in got)


def test_no_words(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.vocabulary(spark.createDataFrame([(None,)] * 9, "word string")).count() == 0


# main text

PROSE = "<p>Some prose stands here, with commas, and it is long enough to count for a few points of its own.</p>"
LINE = PROSE[3:-4]


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<", "<"), ("plain &amp; &#8364; &copy text", "plain & € © text"), ("<div><!-- x", ""), ("<p>", ""), ("<p>a\n b<br>c<p>d <b>e</b>f", "a b c\nd ef"),
    # everything around an article, much of it longer than the article itself
    (f"<head><title>t</title><style>p{{}}</style></head><body class='has-sidebar'><header><h1>Site</h1><p>slogan</p></header><ul class=menu><li><a href=/>home</a></ul><div id='cookie-notice'>{PROSE * 3}</div><div class=post><h1>A &lt; B</h1>{PROSE}<script>'</p>'</script><div class=ad-slot>buy</div><p>End.</div>"
     f"<div class=sidebar>{PROSE * 4}</div><form><label>name</label><input></form><section id=comments>{PROSE * 9}</section><footer>f</footer>", f"A < B\n{LINE}\nEnd."),
    # no names at all: link density and siblings
    (f"<div><a href=1>one</a> <a href=2>two, three</a></div><div><h2>Head</h2><div>{PROSE * 3}</div><div>{PROSE * 2}</div></div><div><a href=9>nine</a></div>", "\n".join(["Head", *[LINE] * 5])),
    (f"<div hidden>{PROSE * 3}</div><div style='display: none'>{PROSE}</div><main><p>kept</main>", "kept"), ("<nav><article><p>inside</article>", "inside"),
    ("<head><title>t</title><p>no body</p>", "no body"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<a title='>' href=\"a>b\">z</a> y", "z y"), ("<ul><li>one<li>two</ul>", "one\ntwo"),
    (f"<div class='topnav'>{PROSE * 2}</div><div id=cookieBar>{PROSE * 2}</div><div class='commentary content'>{PROSE}<div class='user-comments'>{PROSE * 4}</div></div><div id=pageFooter>{PROSE * 3}</div>", LINE),
    ("<article><header><h1>T</h1></header><p>&amp;lt;</p><noscript>no</noscript></article>", "T\n&lt;"),
])
def test_main_text(page, text):
    assert main_text.extract(page) == text


def test_deep_and_long_pages():
    assert main_text.extract("<div>" * 30_000 + "x" + "</div></p>" * 5) == "x"
    assert main_text.extract("<p>a, b" * 20_000) == "\n".join(["a, b"] * 20_000)


def test_op11_on_given_pages(spark):
    d = "/root/testdata/sf0.001"
    for r in spark.read.parquet(f"{d}/pages.parquet").join(queries.op11_main_text(spark, d).drop("url"), "page_id").collect():
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_op11_rows(spark, tmp_path):
    rows = [(1, "u", "<p>a"), (1, "v", "<p>a"), (None, None, None), (2, "w", "<p>b")]
    d = tables(spark, tmp_path, pages=([(*r, "t", 7) for r in rows], PAGES + ", text string, id int"))
    assert sorted(map(tuple, queries.op11_main_text(spark, d).collect()), key=str) == sorted([(1, "u", "a", 1), (1, "v", "a", 1), (None, None, "", 0), (2, "w", "b", 1)], key=str)
    e = tables(spark, tmp_path / "none", pages=([], PAGES))
    assert queries.op11_main_text(spark, e).select(F.count("*")).first()[0] == 0


# fingerprints that many share


def plain_components(values, most):
    group = {v: v for v in values}

    def top(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= most:
                group[top(a)] = top(b)
    return {frozenset(v for v in values if top(v) == r) for r in values if group[r] == r}


def test_crowded_fingerprints(spark, monkeypatch):
    from tissuemill.llm._shared import connected_components

    monkeypatch.setattr(simhash, "_CROWD", 8)
    rng = random.Random(9)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(62), n))
    # dense groups, chains and values that share a third of their bits with a group but are far from it
    values = {0}
    for centre in [rng.getrandbits(62) for _ in range(3)]:
        values |= {flip(centre, rng.randint(0, 5)) for _ in range(60)} | {centre & ((1 << 22) - 1) | rng.getrandbits(40) << 22 for _ in range(60)}
    values |= {flip(v, 3) for v in rng.sample(sorted(values), 60)}
    values = sorted(values)
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), block=16)
    assert all(bin(r["a"] ^ r["b"]).count("1") <= 4 for r in edges.collect())
    groups = {}
    for r in connected_components(edges).collect():
        groups.setdefault(r["component"], {r["component"]}).add(r["node"])
    assert {frozenset(g) for g in groups.values()} == {g for g in plain_components(values, 4) if len(g) > 1}


def test_dense_group_gives_few_links(spark):
    import itertools

    values = [sum(1 << b for b in bits) for n in (0, 1, 2) for bits in itertools.combinations(range(0, 63), n)] + [sum(1 << b for b in bits) for bits in itertools.islice(itertools.combinations(range(63), 3), 3000)]
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    n = edges.count()
    nodes = edges.selectExpr("a as v").union(edges.selectExpr("b as v")).distinct().count()
    # all pairs within four bits would be about a million, and each value has 64 keys
    assert nodes == len(values) and n < 64 * len(values)


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, f"u{i}", rng.randbytes(100_000 if i % 3 else 10).hex()) for i in range(60)] + [(100, "long", rng.randbytes(1_500_000).hex())]
    warc.write_warc(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), file_bytes=400_000)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    # a file is over the bound by less than its last record
    assert len(sizes) > 10 and sorted(sizes)[-2] < 520_000 and max(sizes) < 2_100_000
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {i: (len(h), warc.sha1_base32(h.encode())) for i, _, h in rows}


def test_simhash_never_broadcasts_its_index(spark):
    """Spark sizes the index by the file of fingerprints, from which its 64 keys a value are made."""
    values = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(values)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "(a#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
