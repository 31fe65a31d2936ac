"""Packing: a sharded BM25 index returns unused neighbours that fill each seed's window."""

from __future__ import annotations

import functools
import itertools
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tissuemill.llm._shared import durable

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Signs that may stand behind a word's letters.
_SIGNS = string.punctuation.replace("_", "")
#: Byte-level vocabularies show printable bytes as themselves, the others in turn from 256 on; here spaces stay, as they part words.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = np.zeros(256, "<u4")
_BYTE_CHARS[_SHOWN] = _SHOWN
_BYTE_CHARS[np.setdiff1d(np.arange(256), _SHOWN)] = 256 + np.arange(256 - len(_SHOWN))
_BYTE_CHARS[32] = 32
_PLAIN = bytes(32 if c == 10 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND_OF = np.zeros(256, np.uint8)
_KIND_OF[97:123] = 1
_KIND_OF[list(_SIGNS.encode())] = 2


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in a row, and where each entry begins (one more at the end), both in items of ``kind``."""
    size = np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw.view(kind) if raw.size else np.zeros(0, kind), (ends - ends[0]) // size


class WordIds:
    """Token ids of words as bytes; two generations of a bounded number of words are remembered.

    For tokenizers that drop white space and case and never join across spaces or between
    letters and signs: a text has the ids of its words in a row, and a word of letters and
    ASCII signs behind them has those of both, so the two are parted beforehand. The new
    letter words of many texts go to the tokenizer's model in one call, past its steps
    before it, which would leave them alone; all other words are tokenized as they are.
    """

    def __init__(self, path: str, kind: str, most: int = 200_000):
        self.tokenizer, self.kind, self.most, self.known, self.older = Tokenizer.from_file(path), kind, most, {"": b""}, {}
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        size, suffix = self.tokenizer.get_vocab_size(), self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(size, bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        probe = ["a", "the", "packing", "zqxjkvb", "\u00fcber\u00e9", "\u0434\u0430", "\u6f22\u5b57"]
        self.bulk = bool(suffix) and all(self._ids(w.upper() + "##,") == self._ids(w) + self._ids("##,") for w in probe) and self._bulk(probe) == [self._ids(w) for w in probe]

    def _ids(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def _bulk(self, stems: list[str]) -> list[bytes]:
        """Ids of lower-case letter words: one call for all, cut where a token ends a word."""
        line = _BYTE_CHARS[np.frombuffer(" ".join(stems).encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.letters.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.kind)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, words: list[str]) -> None:
        if not self.bulk:
            self.known.update((w, self._ids(w)) for w in words)
            return
        easy = [w for w in words if w.isalpha() and w.islower() and (w.isascii() or unicodedata.is_normalized("NFC", w))]
        if easy:
            self.known.update(zip(easy, self._bulk(easy)))
        if rest := [w for w in words if w not in self.known]:
            self._learn_others(rest)

    def _learn_others(self, words: list[str]) -> None:
        known = self.known
        # the tokenizer lower-cases letter by letter, so a capital sigma never becomes a final one
        plain = "\n".join(words).replace("\u03a3", "\u03c3").lower().split("\n")
        stems = [w.rstrip(_SIGNS) for w in plain]
        new = [s for s in set(stems).difference(known) if s.isalpha() and (s.isascii() or unicodedata.is_normalized("NFC", s))]
        ids = dict(zip(new, self._bulk(new))) if new else {}
        signs = {"": b""}
        for w, p, s in zip(words, plain, stems):
            found = ids.get(s) or (known.get(s) if s.isalpha() else None)
            if found and len(p) > len(s):
                if (end := p[len(s) :]) not in signs:
                    signs[end] = self._ids(end)
                found += signs[end]
            known[w] = found or self._ids(w)

    def _parted(self, texts: pa.Array) -> pa.Array:
        """The texts with blanks for line ends, A-Z lower-cased, and a blank between a Latin letter and an ASCII sign behind it.

        None of this changes ids, but for texts with ``<|``, which may begin a special
        token whose letters count; where one has it, all keep their letters and signs.
        """
        raw, starts = flat(texts.cast(pa.binary()), "u1")
        if not self.bulk or b"<|" in (data := raw.tobytes()):
            return pc.replace_substring(texts, "\n", " ")
        data = np.frombuffer(data.translate(_PLAIN), np.uint8)
        kinds = _KIND_OF[data]
        letter = kinds == 1
        letter[1:] |= (data[:-1] == 0xC3) & ((data[1:] & 0xDF) != 0x97)  # two bytes of a letter from À to ÿ; not × or ÷
        at = np.flatnonzero(letter[:-1] & (kinds[1:] == 2)) + 1
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer((starts + np.searchsorted(at, starts)).astype(np.int32)), pa.py_buffer(np.insert(data, at, 32)))

    def ids(self, texts: pa.Array) -> pa.Array:
        """The ids of each text, null as empty; a word is looked up once however often the texts hold it."""
        parts = pc.split_pattern(self._parted(pc.fill_null(texts, "")), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) >= self.most:
            self.known, self.older = {"": b""}, self.known
        if fresh := set(words).difference(self.known):
            again = fresh.intersection(self.older)
            self.known.update(zip(again, map(self.older.__getitem__, again)))
            if len(again) < len(fresh):
                self._learn(list(fresh.difference(again)))
        found = pa.array(map(self.known.__getitem__, words), pa.binary(), size=len(words))
        return pc.binary_join(pa.ListArray.from_arrays(parts.offsets, found.take(coded.indices)), b"")


@functools.lru_cache(maxsize=1)
def _words_of(path: str, kind: str) -> WordIds:
    """One worker's memory of words, for all tasks it runs."""
    return WordIds(path, kind)


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _closeness(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text, the smallest hash of two tokens in a row (0 for one token): equal for texts that share most of their pairs."""
    wide = ids.astype(np.uint64)
    pairs = np.full(len(ids), np.iinfo(np.int64).max, np.uint64)
    pairs[:-1] = ((wide[:-1] << np.uint64(20)) + wide[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)
    pairs[starts[1:] - 1] = np.iinfo(np.int64).max
    return np.where(np.diff(starts) > 1, np.minimum.reduceat(pairs, starts[:-1]), 0).astype(np.int64)


def _slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in turn, as many at once as hold about ``most_bytes`` in a column, one at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def tokenize(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """``(doc_id, seq, n, key, ids binary)``: each row's token ids with ``end_id`` last; a null text has that id alone."""
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    kind = _kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words_of(tokenizer, kind)
        end = np.array([end_id], kind).tobytes()
        for b in batches:
            for part in _slices(b, "text"):
                ids = pc.binary_join_element_wise(known.ids(part.column("text")), end, b"")
                all_ids, starts = flat(ids, kind)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("seq"), pa.array(np.diff(starts)), pa.array(_closeness(all_ids, starts)), ids], names=["doc_id", "seq", "n", "key", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("seq"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, seq long, n long, key long, ids binary")


def document_frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Number of documents that hold each token: partial counts per task, summed; one row per token id comes back."""
    kind = _kind(vocabulary)
    bits = max(1, (vocabulary - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _words_of.cache_clear()  # the words are done with
        counts = np.zeros(vocabulary, np.int64)
        for b in batches:
            for part in _slices(b, "ids"):
                ids, starts = flat(part.column("ids"), kind)
                # a text and a token as one number, 32 bits where that is enough, as sorting takes the time
                wide = np.uint32 if part.num_rows <= 1 << (32 - bits) else np.uint64
                held = np.sort(np.repeat(np.arange(part.num_rows, dtype=wide), np.diff(starts)) << wide(bits) | ids.astype(wide))
                held = held[np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))] if len(held) else held
                counts += np.bincount((held & wide((1 << bits) - 1)).astype(np.int64), minlength=vocabulary)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], names=["token", "n"])

    out = np.zeros(vocabulary, np.int64)
    for token, n in tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n")).collect():
        out[token] = n
    return out


class Shard:
    """A BM25 inverted index over the tails of one shard's documents, and the packing of them."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, window: int, k1: float = 1.2, b: float = 0.75, dense_part: int = 8):
        self.window, self.pieces, self.sequence = window, [], 0
        owner = []
        for d, ids in enumerate(docs):
            whole = len(ids) // window
            for i in range(whole):
                self.pieces.append((d, i * window, window, self.sequence, 0))
                self.sequence += 1
            if len(ids) > whole * window:
                owner.append((d, whole * window, len(ids) - whole * window))
        self.doc = [x[0] for x in owner]
        self.start = np.array([x[1] for x in owner], np.int64)
        self.length = np.array([x[2] for x in owner], np.int64)
        if not owner:
            return
        n, sizes = len(owner), self.length.copy()
        tokens = np.concatenate([docs[d][s:] for d, s, _ in owner]).astype(np.int64)
        pairs, tf = np.unique(np.repeat(np.arange(n, dtype=np.int64), sizes) << 32 | tokens, return_counts=True)
        self.term, piece = pairs & 0xFFFFFFFF, pairs >> 32
        self.of = np.searchsorted(piece, np.arange(n + 1))
        weight = idf[self.term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[piece] / sizes.mean()))
        by_term = np.argsort(self.term.astype(docs[0].dtype), kind="stable")
        self.posting, self.weight = piece[by_term], weight[by_term]
        ends = np.cumsum(np.bincount(self.term))
        last = ends[self.term]
        first = last - np.diff(ends, prepend=0)[self.term]
        # frequent terms have a row of weights for all tails, the others a list of postings
        often = (last - first) * dense_part > n
        terms, row = np.unique(self.term[often], return_inverse=True)
        self.dense = np.zeros((len(terms), n), np.float32)
        self.dense[row, piece[often]] = weight[often]
        self.rows = [row[a:z] for a, z in itertools.pairwise(np.concatenate(([0], np.cumsum(often)))[self.of].tolist())]
        self.first, self.last = np.where(often, 0, first), np.where(often, 0, last)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every tail for the seed's terms."""
        own = slice(self.of[seed], self.of[seed + 1])
        lists = [slice(a, z) for a, z in zip(self.first[own].tolist(), self.last[own].tolist()) if z]
        held = np.zeros(len(self.dense), np.float32)
        held[self.rows[seed]] = 1
        near = (held @ self.dense).astype(float)
        if lists:
            near += np.bincount(np.concatenate([self.posting[x] for x in lists]), np.concatenate([self.weight[x] for x in lists]), minlength=len(self.doc))
        return near

    def place(self, tail: int, length: int, offset: int) -> None:
        self.pieces.append((self.doc[tail], int(self.start[tail]), length, self.sequence, offset))
        self.start[tail] += length
        self.length[tail] -= length

    def pack(self, least_cut: int) -> list[tuple[int, int, int, int, int]]:
        """Fill windows: the longest unused tail seeds one, its best neighbours that fit follow, and the best that does not is cut."""
        for seed in np.argsort(-self.length, kind="stable") if self.doc else []:
            if not self.length[seed]:
                continue
            near = self.scores(seed)
            used = int(self.length[seed])
            self.place(seed, used, 0)
            open_ = np.flatnonzero(self.length)
            open_ = open_[np.argsort(-near[open_], kind="stable")]
            fit = open_
            while used < self.window and (fit := fit[self.length[fit] <= self.window - used]).size:
                n = int(self.length[fit[0]])
                self.place(fit[0], n, used)
                used, fit = used + n, fit[1:]
            if self.window - used >= least_cut and (rest := open_[self.length[open_] > self.window - used]).size:
                self.place(rest[0], self.window - used, used)
            self.sequence += 1
        return self.pieces


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, shard_docs: int = 2048, shard_bytes: int = 64 << 20, least_cut: int = 16) -> DataFrame:
    """Pack documents into sequences of at most ``window`` tokens; one row per piece (:data:`PIECES`).

    Every row's text is tokenized whole and ends with ``end_id``. Full windows are
    sequences of their own; what is left of each document is packed in shards of
    ``shard_docs`` documents (fewer, if their ids take over ``shard_bytes``). Shards are cut from rows sorted by the smallest hash of
    their token pairs, so texts that share much meet; a shard's BM25 index uses token
    frequencies of all documents. Rows are spread by ranges of that hash and a row
    number, so no group of copies sits in one task, and a shard is all a task holds.
    A long text is tokenized in one task and takes a few times its length there. Tails of equal length seed in the order of their rows;
    neighbours of equal score follow in that order too. The pieces are written, so all who read them see one packing. Sequence ids are unique but not dense. Null and empty texts are one token; repeated
    rows are packed each; an empty table gives no rows.
    """
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    kind = _kind(vocabulary)
    tokens = durable(tokenize(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id), "pack-tokens")
    df = document_frequencies(tokens, vocabulary)
    n_docs = tokens.count()
    idf = tokens.sparkSession.sparkContext.broadcast(np.log1p((n_docs - df + 0.5) / (df + 0.5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = TaskContext.get().partitionId() << 36, 0
        ids, texts = [], []
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                ids.append(i)
                texts.append(text.as_py())
                held += len(texts[-1])
                if len(ids) >= shard_docs or held >= shard_bytes:
                    out, base = packed(ids, texts, base)
                    ids, texts, held = [], [], 0
                    yield out
        if ids:
            yield packed(ids, texts, base)[0]

    def packed(ids: list[int | None], texts: list[bytes], base: int) -> tuple[pa.RecordBatch, int]:
        arrays = [np.frombuffer(t, kind) for t in texts]
        shard = Shard(arrays, idf.value, window)
        rows = shard.pack(least_cut)
        crc = [zlib.crc32(arrays[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in rows]
        columns = [[ids[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows], crc, [len(arrays[r[0]]) for r in rows], [base + r[3] for r in rows], [r[4] for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")]), base + shard.sequence

    spread = tokens.select("doc_id", "key", "seq", "ids").repartitionByRange("key", "seq").sortWithinPartitions("key", "seq")
    return durable(spread.select("doc_id", "ids").mapInArrow(run, PIECES), "pack-pieces")
