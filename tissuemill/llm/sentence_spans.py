"""Substring deduplication by sliding spans of sentences."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tissuemill.llm._shared import durable, fresh

#: Marks that end a sentence or clause: ASCII ones and those of other scripts.
_MARKS = ".!?,;:\n\u037e\u0387\u0589\u055c-\u055e\u05c3\u060c\u061b\u061f\u06d4\u0700-\u070a\u0964\u0965\u104a\u104b\u1362-\u1368\u1802\u1803\u1808\u1809\u2026\u203c\u203d\u2047-\u2049\u3001\u3002\ufe50-\ufe52\ufe54-\ufe57\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\uff61\uff64"
_SENTENCE = re.compile(f"[^{_MARKS}]+[{_MARKS}]*|[{_MARKS}]+")
_GAP = re.compile(r"[\x20\x09-\x0D]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Sentences of more words are cut further, on average every ``_EVERY`` words.
_LONG, _EVERY = 12, 5


def _cuts(words: list[re.Match]) -> list[int]:
    """Numbers of the words of a long sentence before which it is cut.

    A cut falls where the hash of two neighbouring words says so, hence alike wherever
    the words stand, whatever lies around them.
    """
    keys = [m[0] for m in words]
    return [i + 2 for i in range(len(keys) - 2) if xxhash.xxh3_64_intdigest(f"{keys[i]} {keys[i + 1]}".encode()) % _EVERY == 0]


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, words joined by one space) of each sentence that has a word.

    A sentence runs up to and with the next punctuation marks or line ends; commas,
    semicolons and colons count, so that a long sentence is several and a passage that
    begins within one still has whole ones. Sentences of over ``_LONG`` words are cut
    at words that their content picks. Stretches without a word belong to none.
    """
    out = []
    for m in _SENTENCE.finditer(text):
        words = " ".join(_GAP.split(m[0])).strip(" ")
        if not words:
            continue
        if words.count(" ") < _LONG:
            out.append((m.start(), m.end(), words))
            continue
        found = list(_WORD.finditer(text, m.start(), m.end()))
        ends = [0, *_cuts(found), len(found)]
        for i, j in zip(ends, ends[1:]):
            start, end = m.start() if i == 0 else found[i].start(), m.end() if j == len(found) else found[j].start()
            out.append((start, end, " ".join(w[0] for w in found[i:j])))
    return out


def spans(found: list[tuple[int, int, str]], least: int, words: int) -> list[tuple[int, int, int]]:
    """(first sentence, one past the last, hash) of the shortest runs at a text's :func:`sentences`.

    From each sentence on, and up to each sentence, the fewest in a row that are at least
    ``least`` and hold at least ``words`` words. Any run of that many sentences and words
    that two texts share is covered by such runs within it: a sentence of it either
    begins one that ends in it, or lies in the one that ends where it ends. So these
    stand for runs of every length. A text without any is one run as a whole.
    """
    sizes = [s.count(" ") + 1 for _, _, s in found]
    upto = [0, *itertools.accumulate(sizes)]
    digests = [xxhash.xxh3_64_digest(s.encode()) for _, _, s in found]
    n, end, start, ranges = len(found), 0, 0, set()
    for i in range(n):
        while end < n and (end - i < least or upto[end] - upto[i] < words):
            end += 1
        if end - i < least or upto[end] - upto[i] < words:
            break
        ranges.add((i, end))
    for j in range(1, n + 1):
        while j - start > least and upto[j] - upto[start + 1] >= words:
            start += 1
        if j - start >= least and upto[j] - upto[start] >= words:
            ranges.add((start, j))
    if found and not ranges:
        ranges.add((0, n))
    return [(i, j, xxhash.xxh64_intdigest(b"".join(digests[i:j])) - (1 << 63)) for i, j in ranges]


def _scan(docs: DataFrame, id_col: str, text_col: str, least: int, words: int) -> DataFrame:
    """One row per row of ``docs``: its sentences' places and its runs, as arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                places = [sentences(t) for t in texts]
                runs = [spans(x, least, words) for x in places]
                pick = lambda rows, k, kind: pa.array([[r[k] for r in x] for x in rows], pa.list_(kind))
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("uid"), part.column("text_hash"), pa.array([len(t) for t in texts], pa.int64()), pick(places, 0, pa.int32()), pick(places, 1, pa.int32()),
                    pick(runs, 0, pa.int32()), pick(runs, 1, pa.int32()), pick(runs, 2, pa.int64())], names=["id", "uid", "text_hash", "n_chars", "starts", "ends", "first", "past", "hash"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), _text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, uid long, text_hash long, n_chars long, starts array<int>, ends array<int>, first array<int>, past array<int>, hash array<long>")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(text_col, F.lit("")))


def _not_first(scanned: DataFrame, sample_every: int = 32, share: float = 1e-4) -> DataFrame:
    """``(uid, first, past)`` of the runs whose hash has an earlier place: by id, null last, then row, then position.

    Runs meet by a shuffle on their hash. Hashes that hold over ``share`` of the runs of
    every ``sample_every``-th row, hence at most ``1 / share`` of them, go another way:
    their first places are a grouped minimum, which is broadcast, and their runs are
    dealt by row. The sample only picks the way; either way sees all rows.
    """
    runs = scanned.select("id", "uid", F.explode(F.arrays_zip("first", "past", "hash")).alias("r")).select("id", "uid", "r.first", "r.past", "r.hash")
    some = durable(runs.where(F.pmod(F.xxhash64("uid"), F.lit(sample_every)) == 0).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "span-sample")
    total = scanned.where(F.pmod(F.xxhash64("uid"), F.lit(sample_every)) == 0).agg(F.sum(F.size("hash"))).first()[0] or 0
    often = some.where(F.col("n") > max(share * total, 16)).select("hash", F.lit(True).alias("often"))
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "uid", "first")
    # every run leaves these joins once, whatever is frequent: those that are not share the null group
    marked = runs.join(F.broadcast(often), "hash", "left").groupBy(F.when(F.col("often"), F.col("hash")).alias("frequent"))
    firsts = durable(marked.agg(F.min(place).alias("kept")), "span-frequent").where("frequent is not null")
    found = runs.join(F.broadcast(firsts), runs["hash"] == firsts["frequent"], "left")
    # what is shuffled is narrow: a run's two ends are one number, and frequent runs know already whether they are first
    again = (F.col("uid") != F.col("kept.uid")) | (F.col("first") != F.col("kept.first"))
    ends = F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("past").cast("long"))
    rows = found.select("hash", "id", "uid", ends.alias("ends"), F.when(F.col("frequent").isNotNull(), F.xxhash64("uid")).alias("part"), F.when(F.col("frequent").isNotNull(), again).alias("again"))
    at = F.row_number().over(Window.partitionBy("hash", "part").orderBy(F.col("id").asc_nulls_last(), "uid", "ends"))
    late = rows.withColumn("late", F.when(F.col("part").isNull(), at > 1).otherwise(F.col("again"))).where("late")
    return late.select("uid", F.shiftright("ends", 32).cast("int").alias("first"), F.col("ends").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("past"))


def _joined(starts: pa.Array, ends: pa.Array, firsts: pa.Array, pasts: pa.Array) -> tuple[list[int], list[list[dict[str, int]]]]:
    """Per text, how many sentences its runs cover, and their character ranges with those that overlap or touch joined."""
    covered, places = [], []
    for s, e, first, past in zip(starts, ends, firsts, pasts):
        if not first.is_valid or not len(first.values):
            covered.append(0)
            places.append([])
            continue
        a, z = first.values.to_numpy(), past.values.to_numpy()
        order = np.argsort(a, kind="stable")
        a, z = a[order], np.maximum.accumulate(z[order])
        new = np.concatenate(([True], a[1:] > z[:-1]))
        a, z = a[new], z[np.concatenate((new[1:], [True]))]
        covered.append(int((z - a).sum()))
        places.append([{"start": x, "end": y} for x, y in zip(s.values.to_numpy()[a].tolist(), e.values.to_numpy()[z - 1].tolist())])
    return covered, places


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 2, words: int = 16) -> DataFrame:
    """What each document repeats: ``(id, uid, text_hash, n_chars, n_sentences, n_removed, spans)``.

    Every run of at least ``least`` consecutive sentences and ``words`` words counts, by
    way of the shortest ones (:func:`spans`), and so does a text too short for one. Over
    all documents the first place of each run (by id, then row, then position; null ids
    last) stays, and the sentences under any other place are to be removed. ``spans`` are
    their character ranges ``(start, end)``, ends exclusive, neighbours joined. A passage
    in a third of all documents is no single task's work (:func:`_not_first`).
    Null and empty texts have no sentences; in repeated rows all but one are copies; a
    long text costs its length.
    """
    scanned = durable(_scan(docs, id_col, text_col, least, words), "span-scan")
    covered = _not_first(scanned).groupBy("uid").agg(F.collect_list("first").alias("first"), F.collect_list("past").alias("past"))
    joined = scanned.select("id", "uid", "text_hash", "n_chars", "starts", "ends").join(covered, "uid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, places = _joined(*(b.column(c) for c in ("starts", "ends", "first", "past")))
            sizes = pc.list_value_length(b.column("starts")).cast(pa.int64())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "uid", "text_hash", "n_chars")), sizes, pa.array(removed, pa.int64()), pa.array(places, kind)],
                                             names=["id", "uid", "text_hash", "n_chars", "n_sentences", "n_removed", "spans"])

    return joined.mapInArrow(run, "id long, uid long, text_hash long, n_chars long, n_sentences long, n_removed long, spans array<struct<start:int,end:int>>")


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Texts without the character ranges, which are sorted and apart."""
    return pd.Series([t if s is None else "".join(t[a:b] for a, b in zip([0, *e], [*s, len(t)])) for t, s, e in zip(texts, starts, ends)])


def remove_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the sentences under repeated spans, columns unchanged.

    Spans are joined by id and the hash of the text, so unlike rows under one id have
    their own; rows that are equal in both cannot be told apart and are cut as the one
    of them that loses least, so copies under one id all keep what the first keeps.
    """
    found = repeated_spans(docs, id_col=id_col, text_col=text_col, **options)
    key, text, places = fresh(docs.columns, "span_id", "span_text", "span_places")
    fewest = found.groupBy(F.col("id").alias(key), F.col("text_hash").alias(text)).agg(F.min_by("spans", "n_removed").alias(places)).where(F.size(places) > 0)
    out = docs.join(fewest, docs[id_col].cast("long").eqNullSafe(F.col(key)) & (_text_hash(text_col) == F.col(text)), "left")
    at = lambda end: F.transform(places, lambda s: s[end])
    cut = F.when(F.col(places).isNotNull(), _cut(F.coalesce(text_col, F.lit("")), at("start"), at("end"))).otherwise(F.col(text_col))
    return out.withColumn(text_col, cut).select(*[F.col(f"`{c}`") for c in docs.columns])
