"""Near copies by word shingles: SimHash fingerprints, deletion variants of their segments, verified over whole shingle sets."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuemill.llm._shared import connected_components, durable, fresh, spread_join

_GAP = re.compile(rb"[\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of a shingle.
SHINGLE = 5
#: Words of 64 bits that are compared in whole, and bits of them in which near copies may differ.
SKETCH, MOST = 3, 52
#: Share of bits in which two texts at a similarity of 0.8 differ at most, and the same for up to ``_SHORT`` shingles.
_APART, _APART_SHORT, _SHORT = 0.162, 0.1875, 5
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Groups of more members have a leader and are compared in blocks.
_SMALL = 32


def _words(text: str | None) -> list[bytes]:
    return [w for w in _GAP.split((text or "").encode().translate(_LOWER)) if w]


def shingles(words: list[bytes]) -> np.ndarray:
    """Different hashes of every ``SHINGLE`` words in a row (of all of them, if fewer), as uint64."""
    line, starts = b" ".join(words), [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(line)], np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a : b - 1]) for a, b in zip(starts, starts[SHINGLE:])], np.uint64))


def plan(rows: int, miss: float = 0.002) -> tuple[int, int, int]:
    """Width of a segment, and how many of them usual texts and the shortest need.

    Two fingerprints meet if they differ by at most one bit in some segment; at a
    similarity of 0.8 all segments fail with probability ``miss``. Wider segments for more rows keep chance meetings to
    some 16 a key.
    """
    width = max(16, 2 * math.ceil((math.log2(max(rows, 1)) - 3) / 2))

    def segments(p: float) -> int:
        return math.ceil(math.log(miss) / math.log1p(-((1 - p) ** width) - width * p * (1 - p) ** (width - 1)))

    return width, segments(_APART), segments(_APART_SHORT)


def fingerprint(found: np.ndarray, bits: int) -> np.ndarray:
    """SimHash of a set of shingle hashes: each bit is 1 if it is set in over half of the hashes; ``bits`` of 0 or 1."""
    n = -(-bits // 64)
    total = np.zeros(64 * n, np.int64)
    for at in range(0, len(found), 255):
        mixed = found[at : at + 255, None] * _FACTORS[:n]
        for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(32)
        total += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return (2 * total > len(found))[:bits]


def _parts(found: np.ndarray, width: int, usual: int, short: int) -> list[int]:
    """``SKETCH`` whole words of the fingerprint, then its segments."""
    n = short if len(found) <= _SHORT else usual
    bits = fingerprint(found, 64 * SKETCH + n * width)
    sketch = np.packbits(bits[: 64 * SKETCH], bitorder="little").view("<i8")
    return [*sketch.tolist(), *(bits[64 * SKETCH :].reshape(n, width) @ (1 << np.arange(width))).tolist()]


def _prints(docs: DataFrame, id_col: str, text_col: str, sizes: tuple[int, int, int]) -> DataFrame:
    """``(id, text_hash, key, parts)`` per row; ``key`` is that of the lower-cased words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                words = [_words(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array([xxhash.xxh3_128_hexdigest(b" ".join(w)) for w in words]),
                                                  pa.array([_parts(shingles(w), *sizes) if w else [] for w in words], pa.list_(pa.int64()))], names=["id", "text_hash", "key", "parts"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, key string, parts array<long>")


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _reach(sketches: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within ``most`` bits that connect all that such pairs connect: few comparisons per place of a dense group."""
    rest = np.arange(len(sketches))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            by = np.full(len(rest), -1)
            if len(front) <= len(rest):
                for i in front:
                    by[(by < 0) & (_apart(sketches[i], sketches[rest]) <= most)] = i
                    if by.min() >= 0:
                        break
            else:
                for n, j in enumerate(rest):
                    near = np.flatnonzero(_apart(sketches[j], sketches[front]) <= most)
                    by[n] = front[near[0]] if len(near) else -1
            yield by[by >= 0], rest[by >= 0]
            front, rest = rest[by >= 0], rest[by < 0]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Pairs ``(a, b)`` of places below ``n``, as ``a * n + b``, that connect all that the given ones connect: a spanning
    forest, in which no pair stays whose ends lower pairs connect (Borůvka), so equal groups keep equal pairs."""
    pairs = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    every, kept, rest = np.arange(n), [pairs[:0]], np.arange(len(pairs))
    label = every
    while True:
        x, y = label[pairs[rest] // n], label[pairs[rest] % n]
        apart = x != y
        if not apart.any():
            return np.concatenate(kept)
        rest, x, y = rest[apart], x[apart], y[apart]
        lowest = np.full(n, len(pairs))
        np.minimum.at(lowest, x, rest)
        np.minimum.at(lowest, y, rest)
        mine = np.flatnonzero(lowest < len(pairs))
        taken = pairs[lowest[mine]]
        kept.append(np.unique(taken))
        to = every.copy()
        to[mine] = label[taken // n] + label[taken % n] - mine
        # two that took the same pair point at each other
        to = np.where((to[to] == every) & (every < to), every, to)
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _meet(rows: pa.Table, half: int, most: int) -> pa.Table:
    """Links of rows equal in ``fixed`` and, one bit masked, in ``free``, whose sketches are within ``most`` bits: a spanning forest."""
    rows = rows.sort_by("node")
    fixed, free = (rows[c].to_numpy() for c in ("fixed", "free"))
    nodes, place = np.unique(rows["node"].to_numpy(), return_inverse=True)
    sketches, n = np.stack([rows[f"s{k}"].to_numpy() for k in range(SKETCH)], 1).view(np.uint64), len(nodes)
    links = place[:0]
    for k in range(half):
        variant = fixed << half | free & ~(1 << k)
        order = np.argsort(variant, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(variant[order])) + 1, len(order))
        sizes = np.diff(ends, prepend=0)
        found = [(links // n, links % n)]
        for end, size in zip(ends[sizes > _SMALL], sizes[sizes > _SMALL]):
            run = order[end - size : end]
            found.extend((place[run[i]], place[run[j]]) for i, j in _reach(sketches[run], most))
        end, at, step = np.repeat(ends, sizes), np.flatnonzero(np.repeat(sizes <= _SMALL, sizes)), 1
        while len(at := at[at + step < end[at]]):
            i, j = order[at], order[at + step]
            near = _apart(sketches[i], sketches[j]) <= most
            found.append((place[i[near]], place[j[near]]))
            step += 1
        links = _forest(*(np.concatenate(x) for x in zip(*found)), n)
    return pa.table({"a": pa.array(nodes[links // n], pa.int64()), "b": pa.array(nodes[links % n], pa.int64())})


def variant_links(prints: DataFrame, width: int, *, most: int = MOST, task_rows: int = 1 << 14, block: int = 1 << 17) -> DataFrame:
    """Links ``(a, b)`` between the nodes of ``prints(node, parts)`` that connect what two conditions connect: some segment
    of ``width`` bits differs by at most one bit, and the sketches by at most ``most``.

    The deletion variants of a segment are the segment with one bit masked. The bit lies in
    one half, so a row is shuffled once per half by the other one, and the half's variants are made and
    matched where the rows are. Halves with over ``block`` rows are cut, and each two cuts meet.
    Each task gives a spanning forest of the links it finds, by the order of the nodes; so a dense group, whose members
    meet in most segments, has few different links.
    """
    half = width // 2
    sketch = [F.get("parts", F.lit(k)).alias(f"s{k}") for k in range(SKETCH)]
    prints = prints.where(F.size("parts") > 0)
    rows = prints.select("node", *sketch, F.posexplode(F.slice("parts", SKETCH + 1, F.greatest(F.size("parts") - SKETCH, F.lit(0)))).alias("at", "segment"))
    upper, lower = F.shiftright("segment", half), F.col("segment").bitwiseAND(F.lit((1 << half) - 1))
    place = lambda h, x: (F.shiftleft((2 * F.col("at") + h).cast("long"), half) + x).alias("fixed")
    rows = rows.select("node", *[f"s{k}" for k in range(SKETCH)], F.inline(F.array(F.struct(place(0, upper), lower.alias("free")), F.struct(place(1, lower), upper.alias("free")))))
    counts = durable(rows.groupBy("fixed").agg(F.count(F.lit(1)).alias("n")), "copies-halves")
    tasks = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // task_rows)
    # no more than a row in `block`
    cuts = F.broadcast(counts.where(F.col("n") > block).select("fixed", F.ceil(F.col("n") / block).alias("cuts")))
    rows = rows.join(cuts, "fixed", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "cuts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    task = F.pmod(F.xxhash64("fixed"), F.lit(tasks)).alias("task")
    rows = rows.select(task, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fixed", "free", "node", *[f"s{k}" for k in range(SKETCH)])
    meet = functools.partial(_meet, half=half, most=most)

    def run(table: pa.Table) -> pa.Table:
        return meet(table)

    return rows.groupBy("task", "x", "y").applyInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame) -> DataFrame:
    """``(key, shingles)`` from ``docs(key, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [shingles(_words(t)).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.list_(pa.int64()))], names=["key", "shingles"])

    return docs.mapInArrow(run, "key string, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have a Jaccard similarity of 0.8 or more; the pairs of one that is in many are dealt over tasks."""
    pairs = durable(pairs, "copies-pairs")
    total = max(1, pairs.count())
    for x, other in (("a", "b"), ("b", "a")):
        # texts in over 1/10,000 of all pairs, hence no more than 10,000
        held = F.broadcast(pairs.groupBy(x).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(total * 1e-4, 1000)))
        found = sets.select(F.col("key").alias(x), F.col("shingles").alias(f"s{x}")).join(held, x, "left").fillna(0, "n")
        pairs = spread_join(pairs, found, x, F.col(other), total)
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(5 * common >= 4 * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _link_block(rows: pa.Table) -> pa.Table:
    """Links of one block of a band's open texts with one chunk of its texts: a spanning forest, as ``(a, b)`` keys."""
    rows = rows.combine_chunks()
    own, other = rows.filter(rows["own"]), rows.filter(pc.invert(rows["own"]))
    links: list[tuple[str, str]] = []
    if own.num_rows and other.num_rows:
        values = pc.list_flatten(rows["shingles"]).to_numpy()
        found, ids = np.unique(values, return_inverse=True)
        sizes, mine = pc.list_value_length(rows["shingles"]).to_numpy().astype(np.int64), rows["own"].to_numpy()
        starts = np.concatenate(([0], np.cumsum(sizes)))
        at = np.flatnonzero(~mine)
        flat, cuts = np.concatenate([ids[starts[j] : starts[j + 1]] for j in at]), np.concatenate(([0], np.cumsum(sizes[at])[:-1]))
        held, keys = np.zeros(len(found), np.int64), rows["key"].to_pylist()
        group = {k: k for k in keys}

        def top(k: str) -> str:
            while group[k] != k:
                group[k] = k = group[group[k]]
            return k

        for i in np.flatnonzero(mine):
            held[ids[starts[i] : starts[i + 1]]] = 1
            common = np.add.reduceat(held[flat], cuts)
            held[ids[starts[i] : starts[i + 1]]] = 0
            for j in at[5 * common >= 4 * (sizes[i] + sizes[at] - common)]:
                if (x := top(keys[i])) != (y := top(keys[j])):
                    group[x] = y
                    links.append((keys[i], keys[j]))
    return pa.table({"a": pa.array([min(x) for x in links], pa.string()), "b": pa.array([max(x) for x in links], pa.string())})


def _in_blocks(members: DataFrame, sets: DataFrame, block: int, block_shingles: int = 1_000_000) -> DataFrame:
    """Links ``(a, b)`` that connect what the open texts of ``members(band, key, open)`` match in their bands.

    Open texts are cut into blocks and all texts into chunks by hash, of about ``block``
    texts or ``block_shingles`` each; a task compares one block with one chunk and gives a
    spanning forest, so no pair but a link leaves it.
    """
    rows = members.join(sets, "key")
    cut = lambda which: F.ceil(F.greatest(F.count_if(which) / block, F.sum(F.when(which, F.size("shingles"))) / block_shingles, F.lit(1)))
    sizes = durable(rows.groupBy("band").agg(cut(F.col("open")).alias("blocks"), cut(F.lit(True)).alias("chunks"), F.count(F.lit(1)).alias("n")), "copies-sizes")
    rows = spread_join(rows, sizes, "band", F.col("key"), members.count()).withColumns({"b": F.pmod(F.xxhash64("key"), "blocks"), "c": F.pmod(F.xxhash64("key", F.lit(1)), "chunks")})
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    own = rows.where("open").select("band", "b", upto("chunks").alias("c"), F.lit(True).alias("own"), "key", "shingles")
    other = rows.select("band", upto("blocks").alias("b"), "c", F.lit(False).alias("own"), "key", "shingles")
    return own.unionByName(other).groupBy("band", "b", "c").applyInArrow(_link_block, "a string, b string").distinct()


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = 256) -> DataFrame:
    """One document of each group of near copies, columns unchanged: the row with the smallest id (null ids last).

    Texts with the same words, letter case aside, are copies. Others are linked if their
    sets of five-word shingles have a Jaccard similarity of 0.8 or more, computed on the
    whole sets of candidates; groups are connected components. Candidates come from SimHash
    fingerprints of those sets through deletion variants (:func:`variant_links`): what they connect is
    compared. Of over ``_SMALL`` such texts one leads; those linked to it are of one group, so
    only the others are compared with all, in blocks. So a group of near
    copies costs little more than one comparison per text, and no link that joins two
    groups of candidates is lost. Rows are told apart by id and text, so unlike texts under one id all count.
    Null, empty and blank texts have the same (no) words, so one of them stays; an empty table
    gives no row. A long text costs its length and 16 bytes a word in one task.
    """
    sizes = plan(docs.count())
    prints = durable(_prints(docs, id_col, text_col, sizes), "copies-prints")
    low = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash"))
    classes = durable(prints.groupBy("key").agg(low.alias("low"), F.first("parts").alias("parts")).withColumn("node", F.xxhash64("key")), "copies-classes")
    met = durable(connected_components(variant_links(classes.select("node", "parts"), sizes[0])), "copies-near")
    met = met.union(met.select("component", "component").distinct())
    members = durable(classes.select("key", "node").join(met, "node").select("key", F.col("component").alias("band")), "copies-met")
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("key").alias("turn"), "key")).alias("first"))
    placed = spread_join(members, durable(shared.withColumn("size", F.col("n")), "copies-buckets"), "band", F.col("key"), members.count())
    placed = durable(placed.select("band", "key", "size", F.col("first.key").alias("leader")), "copies-members")
    texts = classes.join(placed.select("key"), "key").select("key", F.col("low.id").alias("_id"), F.col("low.text_hash").alias("_hash"))
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    found = found.join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("key", "text")
    sets = durable(_sets(found).dropDuplicates(["key"]), "copies-sets")
    few = placed.where(F.col("size") <= _SMALL).select("band", "key")
    near = few.withColumnRenamed("key", "a").join(few.withColumnRenamed("key", "b"), "band").where("a < b").select("a", "b")
    many = placed.where(F.col("size") > _SMALL)
    led = many.where("key <> leader").select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"))
    links = durable(_verified(near.union(led).distinct(), sets), "copies-links")
    pair = many.select("band", "key", "leader", F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"))
    linked = pair.join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left")
    marked = linked.select("band", "key", ((F.col("key") != F.col("leader")) & F.col("linked").isNull()).alias("open"))
    marked = durable(marked, "copies-marked")
    unsettled = marked.where("open").select("band").distinct()
    links = links.union(durable(_in_blocks(marked.join(unsettled, "band", "left_semi"), sets, block), "copies-blocks"))
    roots = connected_components(links)
    of = classes.join(roots, classes["key"] == roots["node"], "left").select("low", F.coalesce("component", "key").alias("root"))
    kept = of.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.id").alias("_id"), F.col("low.text_hash").alias("_hash"))
    key, text, own = fresh(docs.columns, "kept_id", "kept_hash", "own_hash")
    out = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(kept.toDF(key, text), F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(text)))
    return out.dropDuplicates([id_col, own]).select(*[F.col(f"`{c}`") for c in docs.columns])
