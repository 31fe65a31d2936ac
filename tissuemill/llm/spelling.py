"""Spelling variants: words one edit apart, by composing minimised acceptors of a vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuemill.llm._shared import durable, spread_join

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups of more words than this are parted further.
MOST = 1000
State = tuple[bool, dict[str, "State"]]


def letter_runs(text: Column) -> Column:
    """Array of the maximal runs of Latin letters of a text, empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("[A-Za-z\\u00C0-\\u00FF]+"), F.lit(0)), F.array().cast("array<string>"))


def lowered(word: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, _UPPER, _LOWER))


def vocabulary(words: DataFrame, *, word_col: str = "word", min_length: int = 6, min_count: int = 5) -> DataFrame:
    """``(word, n)`` of the words of at least so many code points that occur at least so often; nulls are ignored."""
    long = words.where(F.char_length(word_col) >= min_length).groupBy(F.col(word_col).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return long.where(F.col("n") >= min_count)


def acceptor(words: Iterable[str]) -> State:
    """The start of the minimal acyclic acceptor of rising, different words.

    States are ``(accepts, next by code point)``. A state is registered once no later
    word can change it; equal ones become one, so two are the same object exactly if they accept
    the same endings.
    """
    register: dict[tuple, State] = {}
    path: list[tuple[bool, dict[str, State]]] = [(False, {})]
    last = ""

    def fold(depth: int) -> None:
        while len(path) - 1 > depth:
            accepts, edges = path.pop()
            like = (accepts, tuple((c, id(s)) for c, s in edges.items()))
            path[-1][1][last[len(path) - 1]] = register.setdefault(like, (accepts, edges))

    for word in words:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        fold(shared)
        path.extend((False, {}) for _ in range(len(word) - shared))
        path[-1] = (True, path[-1][1])
        last = word
    fold(0)
    return path[0]


def _common(p: State, q: State) -> Iterator[str]:
    """The endings that both states accept."""
    todo = [("", p, q)]
    while todo:
        y, p, q = todo.pop()
        if p[0] and q[0]:
            yield y
        if p is q:
            todo.extend((y + c, s, s) for c, s in p[1].items())
        else:
            few, many = (p[1], q[1]) if len(p[1]) <= len(q[1]) else (q[1], p[1])
            todo.extend((y + c, s, many[c]) for c, s in few.items() if c in many)


def one_edit_pairs(start: State) -> Iterator[tuple[str, str]]:
    """Each pair of accepted words that differ by one code point: what acceptor, one-edit transducer and acceptor accept together.

    Before the edit both acceptors stand in one state, as they have read the same; at the
    edit one or both read a code point of their own; then they go on together. Of the
    places at which one code point may be deleted for the same result, the last one counts.
    """
    todo = [("", start)]
    while todo:
        x, state = todo.pop()
        edges = list(state[1].items())
        for k, (a, p) in enumerate(edges):
            for b, q in edges[k + 1 :]:
                for y in _common(p, q):
                    yield x + a + y, x + b + y
            for y in _common(p, state):
                if not y.startswith(a):
                    yield x + a + y, x + y
            todo.append((x + a, p))


def _window(length: int, path: str) -> tuple[int, int, list[tuple[int, int]]]:
    """What a path of halvings fixes of words of a length: so many code points in front, so many at the end; and the stretches in which a pair must differ."""
    lo, hi, apart = 0, 0, []
    for side in path:
        k = (length - lo - hi) // 2
        if side == "p":
            lo += k
        else:
            apart.append((lo, lo + k))
            hi = length - lo - k
    return lo, hi, apart


def _near_in(length: int, path: str, rows: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """``(word, near words, n of the best, best)`` within one group of ``(word, n)``."""
    lo, hi, apart = _window(length, path)
    turn = -1 if path == "s" else 1  # words that share an end are read from there
    whole = {w[lo : len(w) - hi][::turn]: (w, n) for w, n in rows}
    out: dict[str, list] = {}
    for x, y in one_edit_pairs(acceptor(sorted(whole))):
        u, v = whole[x], whole[y]
        if max(len(u[0]), len(v[0])) == length and not any(u[0][a:b] == v[0][a:b] for a, b in apart):
            for (w, _), (near, n) in ((u, v), (v, u)):
                held = out.setdefault(w, [0, 0, ""])
                held[0] += 1
                if held[0] == 1 or n > held[1] or (n == held[1] and near < held[2]):
                    held[1:] = n, near
    return ((w, k, n, near) for w, (k, n, near) in out.items())


def _placed(rows: DataFrame) -> DataFrame:
    """Rows ``(word, n, length, path, lo, hi)`` with the key of their group: what the path fixes."""
    fixed = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.right("word", F.col("hi")))
    return rows.withColumn("key", F.concat_ws(":", "length", "path", fixed))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row once with the first half of its open code points fixed, once with the others."""
    k = F.floor((F.col("length") - F.col("lo") - F.col("hi")) / 2).cast("int")
    first = F.struct(F.concat("path", F.lit("p")).alias("path"), (F.col("lo") + k).alias("lo"), F.col("hi"))
    other = F.struct(F.concat("path", F.lit("s")).alias("path"), F.col("lo"), (F.col("length") - F.col("lo") - k).alias("hi"))
    return _placed(rows.select("word", "n", "length", F.explode(F.array(first, other)).alias("at")).select("word", "n", "length", "at.*"))


def near_words(vocab: DataFrame, *, most: int = MOST) -> DataFrame:
    """``(word, n_near, best_n, best)`` of every word of ``vocab(word, n)`` with one or more words one edit apart.

    Two words whose longer one has ``length`` code points share, if they are one edit
    apart, the first half of these or the others: the state of the acceptor, read from
    either end, from which their composition starts. So a word has four keys (for its own
    length and as the shorter one of a pair, for each half), and pairs are sought within a
    key; one that shares the first half counts there alone. A key that holds over ``most``
    words is halved again in what it leaves open, until its groups are small
    or one code point is open, in which all words of a group are near each other. So
    no task holds more words than that, whatever half of the vocabulary shares. ``best`` is the near
    word of largest n, the first in code-point order among these.
    """
    size = F.char_length("word")
    rows = vocab.select("word", "n", F.explode(F.array(size, size + 1)).alias("length")).select("*", F.lit("").alias("path"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    rows, settled = _halved(rows), []
    while True:
        rows = durable(rows, "spelling-rows")
        many = durable(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).withColumn("many", F.lit(True)), "spelling-many")
        if many.isEmpty():
            settled.append(rows)
            break
        marked = spread_join(rows.withColumnRenamed("n", "word_n"), many, "key", F.col("word"), rows.count(), "left").withColumnRenamed("word_n", "n")
        marked = durable(marked, "spelling-marked")
        open_ = F.coalesce(F.col("many"), F.lit(False)) & (F.col("length") - F.col("lo") - F.col("hi") > 1)
        settled.append(marked.where(~open_).select(rows.columns))
        rows = _halved(marked.where(open_))
    groups = settled[0]
    for more in settled[1:]:
        groups = groups.union(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        found: list[tuple] = []
        for _, group in groupby(flat, itemgetter(0)):
            first = next(group)
            rest = [(r[3], r[4]) for r in group]
            if rest:
                found.extend(_near_in(first[1], first[2], [(first[3], first[4]), *rest]))
            if len(found) >= 10_000:
                yield _batch(found)
                found = []
        if found:
            yield _batch(found)

    dealt = groups.select("key", "length", "path", "word", "n").repartition("key").sortWithinPartitions("key")
    pairs = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["word", "n_near", "best_n", "best"])


def group_variants(vocab: DataFrame, *, times: int = 5, most: int = MOST) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``vocab(word, n)``.

    ``form`` is the near word of largest n if that is ``times`` the word's n or more, else
    null; ``root`` is where the forms lead from the word (itself without a form). Forms
    grow by ``times`` at every step, so they end; the steps are doubled each round. An
    empty vocabulary gives no row; a word that comes twice must have been counted together before.
    """
    vocab = durable(vocab.select("word", "n"), "spelling-words")
    near = near_words(vocab, most=most)
    has = F.col("best_n") >= times * F.col("n")
    rows = vocab.join(near, "word", "left").select(
        "word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n"))
    rows = durable(rows, "spelling-forms")
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    total = max(1, links.count())
    while True:
        held = links.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        ahead = links.withColumnsRenamed({"word": "_word", "root": "next"}).join(held, F.col("_word") == F.col("root")).select("root", "next", "n")
        moved = spread_join(links, durable(ahead, "spelling-ahead"), "root", F.col("word"), total, "left")
        moved = durable(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
