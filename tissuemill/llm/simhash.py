"""SimHash near-duplicates through deletion-variant signatures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuemill.llm._shared import connected_components, durable, fresh, spread_join

_GAP = re.compile(rb"[\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Keys of more values than this, and than four times the usual, are compared through a leader.
_CROWD = 32


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text as a signed integer; 0 without words.

    A-Z are lower-cased, words joined by one space, and every ``shingle`` words in a
    row hashed with XXH64 (the whole sequence if it is shorter). A bit is set if it is
    in over half of the hashes.
    """
    parts = [w for w in _GAP.split((text or "").encode().translate(_LOWER)) if w]
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        starts = [0]
        for w in parts:
            starts.append(starts[-1] + len(w) + 1)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a : b - 1], seed) for a, b in zip(starts, starts[shingle:])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_hash, fp long)`` for each row; a null text has the fingerprint of an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([fingerprint(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), found], names=["id", "text_hash", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, text_hash long, fp long")


def _segments(bits: int, most: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = most // 2 + 1
    edges = [round(i * bits / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(first: int, width: int) -> int:
    m = ((1 << width) - 1) << first
    return m - (1 << 64) if m >= 1 << 63 else m


def _forest(values: np.ndarray, own: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect whatever values lie within ``most`` bits of one of ``own``: a spanning forest."""
    both = np.concatenate((own, values))
    group = np.arange(len(both))

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    out = []
    for i, v in enumerate(own):
        for j in np.flatnonzero(np.bitwise_count((both ^ v).view(np.uint64)) <= most):
            if (x := top(i)) != (y := top(int(j))):
                group[x] = y
                if v != both[j]:
                    out.append((int(v), int(both[j])))
    return out


def _crowded(index: DataFrame, total: int, most: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Links inside the keys that many values share, and those keys.

    The least value of a key leads: each value within ``most`` bits of it is linked to it
    alone. Only values that it does not reach are compared with all of the key, in blocks of
    ``block``, each of which gives a spanning forest. So a key of k values gives less than
    k links to its leader and a forest per pair of blocks, never all pairs. Which keys
    are crowded is told from counts of hashes first, so keys are counted only where that may be.
    """
    slot = F.xxhash64("key").bitwiseAND(F.lit((1 << 20) - 1))
    slots = index.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    bound = max(_CROWD, 4 * total >> 20)
    open_slots = slots.where(F.col("n") > bound).select("slot")
    keys = index.withColumn("slot", slot).join(open_slots, "slot", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("leader")).where(F.col("n") > bound)
    keys = durable(keys, "simhash-keys")
    rows = durable(spread_join(index, keys, "key", F.col("fp"), total, shuffled=True).select("key", "fp", "leader"), "simhash-crowded")
    led = F.bit_count(F.col("fp").bitwiseXOR(F.col("leader"))) <= most
    links_ = rows.where(led & (F.col("fp") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("fp").alias("b"))
    left = rows.where(~led).groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    sizes = durable(left.join(keys.hint("merge"), "key").select("key", "n", "blocks", F.ceil(F.col("n") / block).alias("chunks")), "simhash-blocks")
    placed = spread_join(rows.withColumn("own", ~led), sizes, "key", F.col("fp"), total, shuffled=True)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    own = placed.where("own").select("key", place("blocks").alias("b"), upto("chunks").alias("c"), "own", "fp")
    other = placed.select("key", upto("blocks").alias("b"), place("chunks").alias("c"), F.lit(False).alias("own"), "fp")

    def run(table: pa.Table) -> pa.Table:
        fp, mine = table["fp"].to_numpy(), table["own"].to_numpy()
        found = _forest(fp[~mine], fp[mine], most)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    blocks = own.unionByName(other).groupBy("key", "b", "c").applyInArrow(run, "a long, b long")
    return links_.union(blocks), keys


def links(prints: DataFrame, most: int = 4, block: int = 2048) -> DataFrame:
    """Pairs ``(a, b)`` of the distinct values of ``prints(fp)`` that differ in 1 to ``most`` bits: enough of them to connect all that such pairs connect.

    With ``most // 2 + 1`` segments, two such values agree but for one bit in some
    segment. Each value is indexed under every segment with one bit masked; equal keys
    are joined, and the join's own condition checks the distance and accepts a pair at
    one key alone (its first near segment, masked at the differing bit, or at the first
    bit if the segments are equal), so no pair comes twice and no candidate leaves the join.
    Keys that many values share are left to :func:`_crowded`, so that a dense group gives links in proportion to its values.
    """
    segments = _segments(64, most)
    keys = [(s, first, width, k) for s, (first, width) in enumerate(segments) for k in range(width)]
    wide = max(width for _, width in segments)

    def key(s: int, first: int, width: int, k: int) -> Column:
        segment = F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(_mask(first, width))), first) if first else F.col("fp").bitwiseAND(F.lit(_mask(first, width)))
        hole = segment.bitwiseAND(F.lit(~(1 << k)))
        return (F.lit((s * 64 + k) << wide) + hole).cast("long")

    index = prints.select("fp", F.explode(F.array(*[key(*x) for x in keys])).alias("key"))
    crowded, many = _crowded(index, len(keys) * prints.count(), most, block)
    # all by shuffle: Spark sizes the index by the file of fingerprints, not by their keys, and would broadcast it
    index = index.join(many.select("key").hint("merge"), "key", "left_anti")
    a, b = index.select("key", F.col("fp").alias("a")), index.select(F.col("key").alias("same"), F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    place = F.shiftright("key", wide)
    accepted = F.lit(False)
    far = F.lit(True)
    for s, (first, width) in enumerate(segments):
        d = diff.bitwiseAND(F.lit(_mask(first, width)))
        at = place - s * 64
        only = (d == 0) & (at == 0) | (d == F.call_function("shiftleft", F.lit(1).cast("long"), (at + first).cast("int")))
        accepted = accepted | ((F.floor(place / 64) == s) & far & only)
        far = far & (F.bit_count(d) >= 2)
    pairs = a.join(b.hint("merge"), (F.col("key") == F.col("same")) & (F.col("a") < F.col("b")) & (F.bit_count(diff) <= most) & accepted).select("a", "b")
    return pairs.union(crowded)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """``(id, fp, component)`` per row: the smallest id reachable over fingerprints ``most`` bits apart.

    Rows with equal fingerprints are one class before anything is joined, so copies cost
    one row each; null and empty texts have the fingerprint zero. A long text costs its length in one task. A null id takes part with its text's class but is never the smallest
    of it unless the class has no other (component null). An empty table gives no rows.
    """
    prints = durable(fingerprints(docs, id_col=id_col, text_col=text_col).select("id", "fp"), "simhash")
    return components(prints, most).select("id", "fp", "component")


def components(prints: DataFrame, most: int) -> DataFrame:
    """``prints(id, fp, …)`` with ``root``, one value per group, and ``component``, its smallest id; a frequent fingerprint is dealt over tasks."""
    total = prints.count()
    classes = durable(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    roots = connected_components(links(classes.select("fp"), most), shuffled=True)
    of = durable(classes.join(roots.hint("merge"), classes["fp"] == roots["node"], "left").select("fp", "low", F.col("n").alias("rows"), F.coalesce("component", "fp").alias("root")), "simhash-roots")
    lowest = of.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("n"))
    of = durable(spread_join(of, lowest, "root", F.col("fp"), total, shuffled=True).select("fp", F.col("rows").alias("n"), "root", "component"), "simhash-components")
    return spread_join(prints, of, "fp", F.coalesce("id", F.monotonically_increasing_id()), total, shuffled=True)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """One document of each group: the row with the smallest id, null last, columns unchanged.

    Rows are told apart by id and text, so unlike texts under one id all count; of rows
    that are equal in both one stays.
    """
    prints = durable(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash")
    low = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash"))
    key, text, own = fresh(docs.columns, "kept_id", "kept_hash", "own_hash")
    kept = components(prints, most).groupBy("root").agg(low.alias("low")).select(F.col("low.id").alias(key), F.col("low.text_hash").alias(text))
    out = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(text)))
    return out.dropDuplicates([id_col, own]).select(*[F.col(f"`{c}`") for c in docs.columns])
