"""Embedding near-dedup by E8 lattice hashing.

Unit vectors are projected onto BLOCKS times eight random orthonormal
directions per table; each eight are decoded to the nearest point of the E8
lattice, and the points together are the vector's cell.  A vector is filed in
its own cell and visits the PROBES cells whose lattice points lie nearest to
its projections: those where one block, or two, move to a neighbouring point.
Vectors filed in a cell are compared with its visitors, and a pair counts only
if its cosine in double precision reaches the threshold.  Each task yields a
spanning forest of the links it finds, never all pairs.

What is dealt by cell are rows of a cell, an id and a 128-bit sign sketch, not
vectors.  In each cell the filed and the visitors are compared by sketches, of
which pairs at the threshold are let through but for one in 10,000, and only ids that have a partner there go on.  Vectors are
fetched for those and compared cell by cell.  A cell where more than CELL are
filed is cut into pieces, and a cell with more visitors than a piece holds is
worked through in segments.

Links are then counted exactly inside the components: a component is cut into
chunks, every pair of chunks is one piece of work, and only counts come back.
Equal vectors enter once with their number.

Recall of single links, measured on random pairs at exactly the threshold 0.9,
is stated by dimension in the README.  Cells are scaled with the root of the
dimension, so that near pairs keep their distance in cells.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _cluster as cl
from . import _words as w
from .components import Forest, components

#: Cells per unit length are SCALE for 64 dimensions; vectors of fewer than eight dimensions per block have fewer blocks.
TABLES, PROBES, BLOCKS, SCALE = 6, 6, 1, 5.0
#: Most vectors filed in a piece of a cell; dense cells that are broadcast.
CELL, DENSE = 4096, 100_000
#: Deviations of a sketch's distance at the threshold that are let through.
SIGMAS = 3.8
THRESHOLD = 0.9
SEED = 20240607
#: A block's moves that take part in probing alone, and in pairs.
MOVES, PAIRED = 12, 4
#: Vectors of a component or a cell in one chunk; cosines computed at once.
CHUNK, PAIRS = 1024, 1 << 21
#: Single precision may miss a cosine by less than this; such pairs are computed again in double.
CLOSE = 1e-4


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


NEIGHBOURS = _minimal()


def _checkerboard(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8: whole coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    off = (x - r)[odd]
    k = np.abs(off).argmax(axis=1)
    r[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 moved by a half."""
    a, b = _checkerboard(x), _checkerboard(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """(n, 1 + probes, width): each point's own cell and those nearest to it; x has eight columns per block."""
    n, blocks = len(x), x.shape[1] // 8
    own = np.stack([decode(x[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
    cost, moves = [], []  # what a move adds to the squared distance, and the neighbours it takes by block (240: none)
    for b in range(blocks):
        extra = 2.0 - 2.0 * ((x[:, 8 * b : 8 * b + 8] - own[:, b]) @ NEIGHBOURS.T)
        near = np.argpartition(extra, MOVES - 1, axis=1)[:, :MOVES]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(extra, near, 1), axis=1, kind="stable"), 1)
        cost.append(np.take_along_axis(extra, near, 1))
        moves.append(near)
    which, price = [], []
    for b in range(blocks):
        for k in range(MOVES):
            which.append({b: k})
            price.append(cost[b][:, k])
    for b, c in itertools.combinations(range(blocks), 2):
        for i, j in itertools.product(range(PAIRED), repeat=2):
            which.append({b: i, c: j})
            price.append(cost[b][:, i] + cost[c][:, j])
    best = np.argsort(np.stack(price, axis=1), axis=1, kind="stable")[:, :probes]
    taken = np.full((len(which), blocks), MOVES)
    for k, w_ in enumerate(which):
        for b, move in w_.items():
            taken[k, b] = move
    vectors = np.concatenate([NEIGHBOURS, np.zeros((1, 8))])
    out = np.repeat(own[:, None], 1 + probes, axis=1)
    rows = np.arange(n)[:, None]
    for b in range(blocks):
        choice = np.concatenate([moves[b], np.full((n, 1), 240)], axis=1)
        out[:, 1:, b] += vectors[choice[rows, taken[best, b]]]
    return out.reshape(n, 1 + probes, -1)


def _keys(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    h = np.full(points.shape[:-1], w.mix(np.array([table * 1_000_003 + dim], np.uint64))[0])
    for k in range(points.shape[-1]):
        h = w.mix(h ^ (points[..., k] * 2).astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def _rotation(table: int, dim: int, blocks: int) -> np.ndarray:
    """Random orthonormal directions: of a dimension below eight, all there are and zeros."""
    size = max(dim, 8)
    return np.linalg.qr(np.random.default_rng([SEED, table, dim]).standard_normal((size, size)))[0][:dim, : 8 * max(1, min(blocks, dim // 8))]


def cell_keys(unit: np.ndarray, table: int, probes: int = PROBES, blocks: int = BLOCKS, scale: float = SCALE) -> np.ndarray:
    """(n, 1 + probes): keys of the own cell and of the probed ones in a table."""
    dim = unit.shape[1]
    return _keys(cells(unit @ _rotation(table, dim, blocks) * (scale * (dim / 64) ** 0.5), probes), table, dim)


def _matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each dimension in a list column."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    return [(at, flat[starts[at][:, None] + np.arange(d)]) for d in np.unique(sizes) if d and len(at := np.flatnonzero(sizes == d))]


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _reached(a: np.ndarray, b: np.ndarray, threshold: float):
    """(row of a, row of b) with cosine at or above the threshold, by blocks; a and b are unit rows."""
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    step = max(1, PAIRS // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(a32[at : at + step] @ b32.T >= threshold - CLOSE)
        ok = np.concatenate([np.einsum("ij,ij->i", a[at + i[k : k + PAIRS // 64]], b[j[k : k + PAIRS // 64]]) >= threshold for k in range(0, len(i), PAIRS // 64)]) if len(i) else np.zeros(0, bool)
        yield at + i[ok], j[ok]


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    """Where each group of rows alike in the first `keys` columns begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _pieces(batches, keys: int, most: int = 1 << 16):
    """Tables of whole groups of rows alike in the first `keys` columns, from batches sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(_starts(table, keys)[-1])
            if last:
                yield table.slice(0, last)
            held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _segments(batches, most: int = 1 << 16):
    """(table, segment): like _pieces for (cell, piece, filed, ...) with the filed of a piece first, but a piece of very many visitors comes in segments, each with all that are filed."""
    held, segment = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = int(_starts(table, 2)[-1])
        if last:
            yield table.slice(0, last), segment
            segment = 0
        rest = table.slice(last)
        if rest.num_rows >= most // 2:
            yield rest, segment
            segment += 1
            rest = rest.slice(0, int(rest.column("filed").to_numpy().sum()))
        held = rest.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), segment


def _runs(total: np.ndarray, most: int):
    at = 0
    while at < len(total):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        yield at, to
        at = to


def _partnered(starts: np.ndarray, rows: int, filed: np.ndarray, sketch: np.ndarray, node: np.ndarray, far: int) -> np.ndarray:
    """Which rows have another of their group within `far` bits, one of the two filed; the filed come first in a group."""
    sizes = np.diff(np.append(starts, rows))
    homes = np.add.reduceat(filed.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    work, met = homes * sizes, np.zeros(rows, bool)
    small = np.flatnonzero((work > 0) & (sizes > 1) & (work <= 4096))
    for lo, hi in _runs(np.cumsum(work[small]), PAIRS):
        g = small[lo:hi]
        n = work[g]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width, first = np.repeat(sizes[g], n), np.repeat(starts[g], n)
        x, y = first + k // width, first + k % width
        ok = (_bits_apart(sketch[:, x], sketch[:, y]) <= far) & (node[x] != node[y])
        met[x[ok]] = met[y[ok]] = True
    for g in np.flatnonzero((work > 4096) & (sizes > 1)).tolist():
        a, b, c = int(starts[g]), int(starts[g] + homes[g]), int(starts[g] + sizes[g])
        step = max(1, PAIRS // (b - a))
        for at in range(a, c, step):
            ok = (_bits_apart(sketch[:, at : min(c, at + step), None], sketch[:, None, a:b]) <= far) & (node[at : min(c, at + step), None] != node[None, a:b])
            met[at : min(c, at + step)] |= ok.any(axis=1)
            met[a:b] |= ok.any(axis=0)
    return met


def _bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[0] ^ y[0]) + np.bitwise_count(x[1] ^ y[1])


def sketches(unit: np.ndarray) -> np.ndarray:
    """(2, n): 128 signs of random projections."""
    signs = unit @ np.random.default_rng([SEED, unit.shape[1], 128]).standard_normal((unit.shape[1], 128)) > 0
    return np.packbits(signs, axis=1).view(np.int64).T


def sketch_limit(threshold: float) -> int:
    p = np.arccos(threshold) / np.pi
    return int(np.ceil(128 * p + SIGMAS * (128 * p * (1 - p)) ** 0.5))


def lattice_links(points: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, blocks: int = BLOCKS, scale: float = SCALE) -> DataFrame:
    """Links (a, b) that join what the lattice finds among points (node, embedding)."""
    cl.ship(points.sparkSession)
    parts, far = cl.shuffle_partitions(points.sparkSession), sketch_limit(threshold)

    def filing(visits: int):
        def file(batches):
            for batch in batches:
                node = batch.column(0).to_numpy()
                for at, m in _matrices(batch.column(1)):
                    for lo in range(0, len(at), 2048):
                        u, rows = _units(m[lo : lo + 2048]), at[lo : lo + 2048]
                        sketch = sketches(u)
                        for t in range(tables):
                            keys = cell_keys(u, t, visits, blocks, scale)
                            n = keys.shape[1]
                            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.tile(np.arange(n) == 0, len(u))), pa.array(np.repeat(node[rows], n)), pa.array(np.repeat(sketch[0], n)), pa.array(np.repeat(sketch[1], n))], names=["cell", "filed", "node", "s0", "s1"])

        return file

    def meet(batches):
        for table, segment in _segments(batches):
            cell, piece, filed, node, *sketch = (table.column(c).to_numpy() for c in ("cell", "piece", "filed", "node", "s0", "s1"))
            met = np.flatnonzero(_partnered(_starts(table, 2), table.num_rows, filed, np.stack(sketch).view(np.uint64), node, far))
            yield pa.RecordBatch.from_arrays([pa.array(cell[met]), pa.array(piece[met]), pa.array(np.full(len(met), segment, np.int32)), pa.array(filed[met]), pa.array(node[met])], names=["cell", "piece", "segment", "filed", "node"])

    def compare(batches):
        forest = Forest()
        for table in _pieces(batches, 3):
            filed, node = table.column("filed").to_numpy(), table.column("node").to_numpy()
            vectors = table.column("embedding").combine_chunks()
            starts = _starts(table, 3)
            for lo, hi in zip(starts.tolist(), np.append(starts[1:], table.num_rows).tolist(), strict=True):
                for at, m in _matrices(vectors.slice(lo, hi - lo)):
                    unit, r = _units(m), lo + at
                    x = np.flatnonzero(filed[r])
                    for i, j in _reached(unit, unit[x], threshold):
                        ok = i != x[j]
                        forest.add(node[r[i[ok]]], node[r[x[j[ok]]]])
        a, b = forest.links()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    slim, rows = points.select("node", "embedding"), "cell long, filed boolean, node long, s0 long, s1 long"
    dense = cl.cut(slim.mapInArrow(filing(0), rows).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("_k")))
    sent = slim.mapInArrow(filing(probes), rows)
    sent = sent.join(F.broadcast(dense) if dense.count() <= DENSE else dense, "cell", "left")
    own = F.when(F.col("filed"), F.pmod(F.xxhash64("node", F.lit("piece")), F.coalesce("_k", F.lit(1)))).cast("int")
    dealt = sent.withColumn("_own", own).withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1)))
    dealt = dealt.select("cell", "piece", F.coalesce(F.col("_own") == F.col("piece"), F.lit(False)).alias("filed"), "node", "s0", "s1")
    met = dealt.repartition(parts, "cell", "piece").sortWithinPartitions("cell", "piece", F.desc("filed")).mapInArrow(meet, "cell long, piece int, segment int, filed boolean, node long")
    work = met.join(slim, "node").select("cell", "piece", "segment", "filed", "node", "embedding")
    return work.repartition(parts, "cell", "piece", "segment").sortWithinPartitions("cell", "piece", "segment").mapInArrow(compare, "a long, b long")


def count_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, n): weights linked to each of members (component, node, times, embedding), itself included, by exact comparison inside components."""
    cl.ship(members.sparkSession)
    parts = cl.shuffle_partitions(members.sparkSession)
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))
    own = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("_chunks")).cast("int")
    spread = members.join(sizes, "component").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    work = spread.select("component", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), (F.col("_own") <= F.col("_other")).alias("first"), "node", "times", "embedding")

    def count(batches):
        for table in _pieces(batches, 3):
            lo, hi, node, times, first = (table.column(c).to_numpy() for c in ("lo", "hi", "node", "times", "first"))
            vectors = table.column("embedding").combine_chunks()
            starts = _starts(table, 3)
            for begin, end in zip(starts.tolist(), np.append(starts[1:], table.num_rows).tolist(), strict=True):
                for at, m in _matrices(vectors.slice(begin, end - begin)):
                    unit, r = _units(m), begin + at
                    a, b = np.flatnonzero(first[r]), np.flatnonzero(~first[r])
                    same = lo[begin] == hi[begin]
                    if same:
                        b = a
                    found = np.zeros(len(r), np.int64)
                    for i, j in _reached(unit[a], unit[b], threshold):
                        np.add.at(found, a[i], times[r[b[j]]])
                        if not same:
                            np.add.at(found, b[j], times[r[a[i]]])
                    yield pa.RecordBatch.from_arrays([pa.array(node[r]), pa.array(found)], names=["node", "n"])

    return work.repartition(parts, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def dedup_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, blocks: int = BLOCKS, scale: float = SCALE) -> DataFrame:
    """(id, n_links, component, kept) per row: other rows linked by a cosine of at least threshold, and the smallest id reachable.

    Null, zero and empty vectors and those with null or non-finite components
    link with nothing; vectors of different length never link.  Rows that share
    an id are one node: their links are pooled.  A row with a null id links
    with nothing and is kept.  Other columns are not carried, so none can
    clash.  Empty tables give empty results.
    """
    e = F.col("embedding")
    slim = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("embedding"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    valid = slim.where(F.col("id").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False)))
    classes = cl.cut(valid.groupBy("embedding").agg(F.min("id").alias("node"), F.count("*").alias("times")))
    found = components(lattice_links(classes, threshold, tables, probes, blocks, scale))
    linked = classes.join(found, "node")
    counts = count_links(linked.select("component", "node", "times", "embedding"), threshold)
    per_class = classes.join(found, "node", "left").join(counts, "node", "left").select("embedding", F.coalesce("component", "node").alias("component"), F.coalesce(F.col("n"), F.col("times")).alias("n"))
    rows = valid.join(per_class, "embedding", "left").select("id", (F.col("n") - 1).alias("n_links"), "component")
    rest = slim.where(~(F.col("id").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False)))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return rows.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
