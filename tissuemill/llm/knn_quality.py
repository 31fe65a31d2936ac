"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GAP = re.compile(r"[\x20\x09-\x0D]+")
N_WORDS, N_SHAPES, N_LEVELS = 1024, 128, 48
N_TERMS = N_WORDS + N_SHAPES + N_LEVELS


def _shape(word: str) -> str:
    """How a word is written: the classes of its first letters and of its last characters, and its length's class."""
    kind = lambda c: "A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else c if c.isascii() else "?"
    return kind(word[0]) + kind(word[min(1, len(word) - 1)]) + kind(word[-1]) + kind(word[-min(2, len(word))]) + str(min(len(word) // 4, 4))


class Terms(dict):
    """A word's two hashed terms, lower-cased word and shape, as one number; remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = zlib.crc32(word.lower().encode()) % N_WORDS * N_SHAPES + zlib.crc32(_shape(word).encode()) % N_SHAPES
        self[word] = value
        return value


def term_vector(text: str | None, terms: Terms) -> np.ndarray:
    """Counts of a whole text's terms: words, shapes of words, and how repetitive and long it is; zeros without words."""
    out = np.zeros(N_TERMS, np.float32)
    found = [w for w in _GAP.split(text or "") if w]
    if not found:
        return out
    both = np.fromiter(map(terms.__getitem__, found), np.int64, len(found))
    out[:N_WORDS] = np.log1p(np.bincount(both // N_SHAPES, minlength=N_WORDS))
    shapes = np.bincount(both % N_SHAPES, minlength=N_SHAPES)
    out[N_WORDS : N_WORDS + N_SHAPES] = np.sqrt(shapes / len(found))
    stutter = float((both[1:] == both[:-1]).mean()) if len(both) > 1 else 0.0
    runs = both[: max(0, len(both) - 4)]
    for k in range(1, 5):
        runs = runs * 1_000_003 + both[k : k + len(runs)]  # wraps around, as hashes do
    repeat = 1 - len(np.unique(runs)) / len(runs) if len(runs) else 0.0
    levels = out[N_WORDS + N_SHAPES :]
    levels[min(15, int(stutter * 16))] = levels[16 + min(15, int(repeat * 16))] = 1
    levels[32 + min(15, int(np.log2(len(found))))] = 0.5
    return out


@dataclass(frozen=True)
class Model:
    """Term weights, projection to the latent space, labelled unit vectors there, their labels and the share of label 1."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, terms: np.ndarray) -> np.ndarray:
        """Unit latent vectors of term rows; zero rows stay zero."""
        x = weighted(terms, self.weights) @ self.projection
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, terms: np.ndarray, k: int = 25, block: int = 256) -> np.ndarray:
        """Share of label 1 among the ``k`` nearest labelled vectors, weighted by the fourth power of the cosine."""
        out = np.full(len(terms), self.prior)
        k = min(k, len(self.labels))
        for s in range(0, len(terms) if k else 0, block):
            near = np.maximum(self.latent(terms[s : s + block]) @ self.vectors.T, 0)
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            w = np.take_along_axis(near, best, 1).astype(np.float64) ** 4
            total = w.sum(axis=1)
            vote = (w * self.labels[best]).sum(axis=1)
            out[s : s + block] = np.where(total > 0, vote / np.maximum(total, 1e-300), self.prior)
        return out


def weighted(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted terms, words and the rest each of unit length at most, so that neither drowns the other."""
    x = terms * weights
    for part in (slice(0, N_WORDS), slice(N_WORDS, N_WORDS + N_SHAPES), slice(N_WORDS + N_SHAPES, N_TERMS)):
        x[:, part] /= np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-12)
    x[:, :N_WORDS] *= 0.5
    return x


def remainder(id_col: Column) -> Column:
    """``crc32(id as text) mod 3``; of a null id that of the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 1, most_rows: int = 6000, n_latent: int = 64) -> Model:
    """Fit on at most ``most_rows`` labelled rows outside the held-out remainder, in hash order of their ids.

    Term vectors are made where the texts are; the driver gets that bounded sample
    alone, weighs words by inverse document frequency and takes the leading directions of the
    sample (a truncated singular value decomposition). An id with several labels counts as
    0 if one is; null labels and ids teach nothing. Without labelled rows every score is 0.5.
    """
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(F.col(id_col)) != held_out))
    chosen = named.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col)).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            rows = [term_vector(t, terms) for t in b.column("text").to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_label"), pa.array(at, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(rows, at)], pa.list_(pa.float32()))], names=["_id", "_label", "at", "value"])

    id_type = docs.schema[id_col].dataType.simpleString()
    found = sample.mapInArrow(run, f"_id {id_type}, _label int, at array<int>, value array<float>").orderBy(F.xxhash64("_id"), "_id").limit(most_rows).collect()
    x, y = np.zeros((len(found), N_TERMS), np.float32), np.array([r["_label"] for r in found], np.float64)
    for i, r in enumerate(found):
        x[i, r["at"]] = r["value"]
    kept = x.any(axis=1)
    x, y = x[kept], y[kept]
    weights = np.ones(N_TERMS, np.float32)
    if len(x):
        weights[:N_WORDS] = np.log((1 + len(x)) / (1 + (x[:, :N_WORDS] > 0).sum(axis=0)))
    z = weighted(x, weights).astype(np.float64)
    _, directions = np.linalg.eigh(z.T @ z)
    model = Model(weights, directions[:, ::-1][:, :n_latent].astype(np.float32), np.zeros((0, n_latent), np.float32), y, float(y.mean()) if len(y) else 0.5)
    return Model(weights, model.projection, model.latent(x) if len(x) else model.vectors, y, model.prior)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for each row; null and empty texts get the share of label 1 among the labelled; an empty table gives no row.

    Rows stay apart, repeated ids too. A long text costs its length in one task. Of labelled
    vectors that are equally near at the edge of the neighbourhood any may vote, the same in every run.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = np.stack([term_vector(t, terms) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(shared.value.score(x), pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
