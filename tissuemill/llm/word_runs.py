"""Runs: maximal stretches of words that repeat with a period, found through string synchronising sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuemill.llm._shared import fresh

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    x = a * _ODD[0] + b * _ODD[1]
    x ^= x >> np.uint64(32)
    x *= _ODD[2]
    return x ^ (x >> np.uint64(29))


def _next_equal(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each of the rising ``places`` the distance to the next one with an equal key, 0 if there is none."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    out = np.zeros(len(keys), np.int64)
    out[order[same]] = places[order[same + 1]] - places[order[same]]
    return out


def _windows_least(values: np.ndarray, length: int) -> np.ndarray:
    """The least value of every window of ``length``, a power of two and one more."""
    least, k = values, 1
    while k < length - 1:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    return np.minimum(least[:-1], values[length - 1 :])


def _stretches(distance: np.ndarray, period_most: int) -> Iterator[tuple[int, int, int]]:
    """``(first, last, p)`` of maximal stretches of places with one and the same distance ``p`` in 1..``period_most``."""
    fits = (distance > 0) & (distance <= period_most)
    if fits.any():
        edge = np.flatnonzero(np.concatenate(([True], distance[1:] != distance[:-1], [True])))
        for a, b in zip(edge[:-1], edge[1:]):
            if fits[a]:
                yield int(a), int(b) - 1, int(distance[a])


def _extended(ids: np.ndarray, i: int, d: int, known: int) -> tuple[int, int]:
    """The maximal stretch ``[start, end)`` with period ``d`` around words ``[i, i + known)``, which have it."""
    n, start, end, step = len(ids), i, i + known, known
    while end < n:
        hi = min(n, end + step)
        bad = np.flatnonzero(ids[end:hi] != ids[end - d : hi - d])
        if len(bad):
            end += int(bad[0])
            break
        end, step = hi, 2 * step
    step = known
    while start > 0:
        lo = max(0, start - step)
        bad = np.flatnonzero(ids[lo:start] != ids[lo + d : start + d])
        if len(bad):
            start = lo + int(bad[-1]) + 1
            break
        start, step = lo, 2 * step
    return start, end


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Every run ``(start, length, period)`` of a sequence of word numbers, by start and period.

    At each scale t = 2, 4, 8, … a place i is in the synchronising set if, among the hashes of
    the windows of t words at i..i+t, the least is that at i or at i+t. Windows in highly
    periodic regions (period at most t/3) are left out. So membership depends on the 2t words from i alone, and any 3t
    words without such a period have a member among the first t. A run of period q in [t, 2t) therefore has a
    member within its first t places; the same context recurs q places on, and not
    before, as a run's period is primitive: consecutive members with equal contexts at a distance in [t, 2t)
    propose the periods, which are extended word by word. The regions that a scale leaves
    out are found by stretches of places whose window of t/2 words recurs at one and the same
    distance; they supply the periods 1 and 2, below the first scale's reach. A scale at
    which no window of t/2 words recurs is the last. Time n log n; hashes only propose, words decide.
    """
    n, found = len(ids), set()
    if n < LEAST:
        return []
    half = _mixed(ids.astype(np.uint64), ids.astype(np.uint64))
    open_ = np.ones(n, bool)  # places whose half windows may recur
    t = 2
    while t <= n and (t <= 8 or TIMES * t <= n):
        whole = _mixed(half[: n - t + 1], half[t // 2 : n - t // 2 + 1])
        skip = np.zeros(len(whole), bool)
        if t >= 4:
            places = np.flatnonzero(open_[: len(half)])
            if not len(places):
                break
            distance = np.zeros(len(half), np.int64)
            distance[places] = _next_equal(half[places], places)
            recurs = distance > 0
            if not recurs.any():
                break
            back = np.flatnonzero(recurs)
            recurs[back + distance[back]] = True
            open_ = np.zeros(n, bool)
            open_[: len(whole)] = recurs[: len(whole)] & recurs[t // 2 : t // 2 + len(whole)]
            for a, b, p in _stretches(distance, t // 3):
                if (b - a + 1) + t // 2 + p >= t:
                    skip[a : b + t // 2 + p - t + 1] = True
                    if p <= 2:
                        start, end = _extended(ids, a, p, b - a + t // 2 + p)
                        if end - start >= max(LEAST, TIMES * p):
                            found.add((start, end - start, p))
        if len(whole) > t:
            hashes = np.where(skip, np.iinfo(np.uint64).max, whole)
            least = _windows_least(hashes, t + 1)
            m = len(least)
            member = ((least == hashes[:m]) & ~skip[:m]) | ((least == hashes[t : t + m]) & ~skip[t : t + m])
            at = np.flatnonzero(member & (open_[:m] if t >= 4 else True))
            gap = _next_equal(_mixed(whole[at], whole[at + t]), at)
            hit = (gap >= t) & (gap < 2 * t)
            reach: dict[int, int] = {}
            for i, d in zip(at[hit].tolist(), gap[hit].tolist()):
                if i < reach.get(d, 0):
                    continue
                start, end = _extended(ids, i, d, d)
                reach[d] = end - d  # places up to there propose the same stretch
                if end - start >= max(LEAST, TIMES * d):
                    found.add((start, end - start, d))
        half, t = whole, 2 * t
    return sorted(found, key=lambda r: (r[0], r[2]))


def _numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the place of its first like."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, runs array<struct<start, length, period>>, collapsed)`` of every row's whole text.

    Words are what blanks (``[\\x20\\x09-\\x0D]``) part; a run is a stretch of at least
    ``LEAST`` words and ``TIMES`` its smallest period that no neighbouring word extends.
    ``collapsed`` joins by one space the words that no run holds after its first period. Runs are
    ordered by start, then period. Rows stay apart, repeated ids too; a null or empty text
    has no words, no run and an empty ``collapsed``; an empty table gives no row. A text is
    one task's work: it takes some 60 bytes a word there; none is cut.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                counts, runs, texts = [], [], []
                for text in part.column(1):
                    words = (text.as_py() or "").encode().split()  # bytes split at the blanks above
                    found = runs_of(_numbered(words))
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    texts.append(b" ".join(_kept(words, found)).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(texts, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def collapse(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with each run's words after its first period taken out; other texts, and all other columns, stay as they are."""
    (key,) = fresh(docs.columns, "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = []
                for text in part.column(0).field(text_col):
                    words = (text.as_py() or "").encode().split()
                    found = runs_of(_numbered(words))
                    texts.append(b" ".join(_kept(words, found)).decode() if found else text.as_py())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "collapsed"])

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(key)
    schema = docs.select(whole).schema.add("collapsed", "string")
    out = docs.select(whole).mapInArrow(run, schema)
    return out.select(*[(F.col("collapsed") if c == text_col else F.col(key)[c]).alias(c) for c in docs.columns])
