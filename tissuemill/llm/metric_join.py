"""Embedding near-duplicates: an exact range join over cells of pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tissuemill.llm._shared import connected_components, durable, spread_join


def raw_rows(vectors: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in double precision, the largest component 1, zeros behind shorter vectors up to ``width``; and the lengths."""
    flat = pc.list_flatten(vectors)
    flat = (flat.to_numpy(zero_copy_only=False) if isinstance(flat, pa.Array) else flat.to_numpy()).astype(np.float64)
    n = pc.list_value_length(vectors).to_numpy().astype(np.int64) if isinstance(vectors, pa.ChunkedArray) else pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    if (n == width).all():
        x = flat.reshape(len(n), width)
    else:
        x = np.zeros((len(n), width))
        x[np.arange(width)[None, :] < n[:, None]] = flat
    return x / np.abs(x).max(axis=1, keepdims=True), n


def unit_rows(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of unit length in double precision."""
    x, _ = raw_rows(vectors, width)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine of two rows whose sums are rounded once."""
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def vector_classes(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, v, fit)`` and one class ``(cid, low, v, n)`` per different vector that can link.

    Vectors that are null, empty, zero or hold a null or non-finite component cannot link, nor rows without id.
    Vectors of floats stay so, all others are of doubles.
    """
    kind = rows.schema[vector_col].dataType
    v = F.col(vector_col) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull(), F.lit(False))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), fit.alias("fit"))
    classes = kept.where("fit").groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    return kept, durable(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")


def choose_pivots(classes: DataFrame, width: int, per_cell: int, most: int) -> np.ndarray:
    """Unit vectors of the pivots: one per ``per_cell`` classes, at most ``most``, in hash order."""
    n = classes.count()
    if not n:
        return np.zeros((0, 0))
    k = min(most, max(1, math.ceil(n / per_cell)))
    return unit_rows(classes.orderBy(F.xxhash64("v"), "cid").limit(k).select("v").toArrow()["v"], width)


def _cells(classes: DataFrame, pivots: np.ndarray, radius: float, part_rows: int = 512) -> DataFrame:
    """``(cell, home, cid, n, v)``: each class in the cell of its nearest pivot, and in earlier cells it may reach.

    A vector nearer to pivot i than to j lies at least ``(d_j^2 - d_i^2) / (2 d_ij)`` from
    any point of cell j: the triangle inequality's bound for a hyperplane. Of two cells the
    one with the smaller number gets the copy. The slack outweighs rounding, which for
    pivots that nearly coincide may misjudge their distance by some 1e-8.
    """
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    kind = classes.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
        for b in batches:
            for start in range(0, b.num_rows, part_rows):
                part = b.slice(start, part_rows)
                x = unit_rows(part.column("v"), p.shape[1])
                d2 = 2 - 2 * (x @ p.T)
                home = d2.argmin(axis=1)
                gap = d2 - d2[np.arange(len(x)), home][:, None]
                near = gap <= 2 * radius * apart[home] + 1e-7
                near &= np.arange(len(p))[None, :] < home[:, None]
                row, cell = np.nonzero(near)
                at = pa.array(np.concatenate((np.arange(len(x)), row)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((home, cell)), pa.int32()), pa.array(np.arange(len(at)) < len(x)),
                    part.column("cid").take(at), part.column("n").take(at), part.column("v").take(at)], names=["cell", "home", "cid", "n", "v"])

    return classes.select("cid", "n", "v").mapInArrow(run, f"cell int, home boolean, cid long, n long, v {kind}")


def _link_block(threshold: float, width: int):
    """Links of one block of a cell's own vectors with one chunk of its vectors: weights and a spanning forest."""
    def run(rows: pa.Table) -> pa.Table:
        own, other = rows.filter(rows["own"]), rows.filter(pc.invert(rows["own"]))
        cids, links, roots = (np.zeros(0, np.int64) for _ in range(3))
        if own.num_rows and other.num_rows:
            (ra, da), (rb, db) = raw_rows(own["v"], width), raw_rows(other["v"], width)
            a, b = (r / np.sqrt((r * r).sum(axis=1, keepdims=True)) for r in (ra, rb))
            ia, ib, na, nb = own["cid"].to_numpy(), other["cid"].to_numpy(), own["n"].to_numpy(), other["n"].to_numpy()
            home = other["home"].to_numpy()
            hit = np.zeros((len(a), len(b)), bool)
            wa, wb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            for s in range(0, len(a), 512):
                part = slice(s, s + 512)
                near = a[part] @ b.T
                block = near >= threshold
                # products of rows of unit length may err by some 1e-15; what is that near is computed anew
                for i, j in np.argwhere(np.abs(near - threshold) < 1e-12):
                    block[i, j] = cosine(ra[s + i], rb[j]) >= threshold
                if not block.any():
                    continue
                # of two vectors of this cell, the pair is counted where the other has the larger id
                block &= ~home[None, :] | (ib[None, :] > ia[part, None])
                block &= da[part, None] == db[None, :]
                hit[part] = block
                wa[part] = block @ nb
                wb += na[part] @ block
            root_a, root_b = _forest(hit, ia, ib)
            some_a, some_b = wa > 0, wb > 0
            cids, links, roots = (np.concatenate((x[some_a], y[some_b])) for x, y in ((ia, ib), (wa, wb), (root_a, root_b)))
        return pa.table({"cid": pa.array(cids, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(roots, pa.int64())})

    return run


def _forest(hit: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id in the component of each row and column of a bipartite link matrix."""
    root_a, root_b = ia.copy(), ib.copy()
    todo = hit.any(axis=1)
    seen_b = np.zeros(len(ib), bool)
    while todo.any():
        frontier = np.array([todo.argmax()])
        rows, cols = [frontier], []
        todo[frontier] = False
        while frontier.size:
            new_b = np.flatnonzero(hit[frontier].any(axis=0) & ~seen_b)
            seen_b[new_b] = True
            cols.append(new_b)
            frontier = np.flatnonzero(hit[:, new_b].any(axis=1) & todo) if new_b.size else new_b
            todo[frontier] = False
            rows.append(frontier)
        r, c = np.concatenate(rows), np.concatenate(cols)
        low = min(ia[r].min(), ib[c].min())
        root_a[r] = low
        root_b[c] = low
    return root_a, root_b


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, per_cell: int = 4096, most_pivots: int = 1024, block: int = 4096) -> DataFrame:
    """``(id, n_links, component, kept)`` for each row: links at a cosine of ``threshold`` or more.

    Equal vectors are one class with a weight, whatever their ids. Unit vectors at that cosine are at most
    ``sqrt(2 - 2 threshold)`` apart; pivots cut them into cells, boundary vectors are copied to
    the cells they may reach, and cells join on their own, by matrix products in
    double precision; a pair within 1e-12 of the threshold is decided by sums that are rounded once.
    A cell's own vectors are cut into blocks and all its vectors into chunks by
    hash, of about ``block`` each, so a dense cell is many tasks. Tasks return sums of links and a
    spanning forest, never all pairs. The driver sees the pivots and the cell sizes,
    both bounded by ``most_pivots``. Rows that cannot link have 0 links and are their own
    component; so are rows without id (null). Repeated rows link with each other.
    Vectors of different lengths do not link; shorter ones take the room of the longest.
    """
    kept, classes = vector_classes(rows, id_col=id_col, vector_col=vector_col)
    width, total = classes.agg(F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    pivots = choose_pivots(classes, width, per_cell, most_pivots)
    cells = durable(_cells(classes, pivots, math.sqrt(2 - 2 * threshold) + 1e-9), "vector-cells")
    sizes = cells.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("long")) / block).alias("blocks"), F.ceil(F.count(F.lit(1)) / block).alias("chunks"))
    placed = cells.join(F.broadcast(sizes), "cell").withColumns({"b": F.pmod(F.xxhash64("cid"), "blocks"), "c": F.pmod(F.xxhash64("cid", F.lit(1)), "chunks")})
    own = placed.where("home").select("cell", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), F.lit(True).alias("own"), "home", "cid", "n", "v")
    other = placed.where("blocks > 0").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"), "c", F.lit(False).alias("own"), "home", "cid", "n", "v")
    linked = durable(own.unionByName(other).groupBy("cell", "b", "c").applyInArrow(_link_block(threshold, width), "cid long, links long, root long"), "vector-links")
    weight = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.join(weight, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    named = durable(named.select("v", "low", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("root")), "vector-named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("n"))
    named = durable(spread_join(named.withColumnRenamed("n", "rows"), lowest, "root", F.col("low"), total).select("v", F.col("rows").alias("n"), "n_links", "component"), "vector-named")
    unit = spread_join(kept.where("fit").select("id", "v"), named, "v", F.col("id"), total).select("id", "n_links", "component")
    alone = kept.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return unit.unionByName(alone).withColumn("kept", F.col("id") == F.col("component"))
