"""SimHash near-dedup by anchor-point covering.

Two 64-bit fingerprints within 3 bits differ by at most one bit in one of
their 32-bit halves.  Each half (its first 31 bits) is covered by the perfect
Hamming code of length 31: every point has exactly one codeword within the
covering radius 1, its home anchor.  A fingerprint is filed at its home and
replicated to every anchor within covering radius plus threshold of the half
(1 + 1 = 2), and the ones filed at an anchor are compared with the ones
replicated to it; the comparison uses all 64 bits.  The last bit of a half
takes no part in the anchor, so it can't lose a link.

A fingerprint is replicated about 16 times per half, 2**26 anchors keep the
groups short, and comparisons inside a group run in blocks that yield a
spanning forest, never all pairs.  Documents of equal fingerprints enter once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _cluster as cl
from . import _words as w
from .components import Forest, components

SEED = 42
SHINGLE = 3
#: Shingle hashes expanded to bits at once, and pairs compared at once.
STEP = 1 << 15
PAIRS = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None) -> int:
    """Majority of the shingle hashes' bits: set where over half of them have a one."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return 0
    if len(found) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = len(found) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    lo, hi = starts[:n].tolist(), (ends[SHINGLE - 1 :] - 1).tolist()
    for at in range(0, n, STEP):
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(lo[at : at + STEP], hi[at : at + STEP], strict=True)), np.uint64, min(STEP, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _parity_table() -> np.ndarray:
    """XOR of the positions 1..31 of the set bits, for each 16-bit half of a word."""
    low = np.zeros((2, 1 << 16), np.uint32)
    for half in range(2):
        for bit in range(16):
            if (place := 16 * half + bit + 1) <= 31:
                low[half] ^= np.where(np.arange(1 << 16) >> bit & 1, place, 0).astype(np.uint32)
    return low


_SYNDROME = _parity_table()


def syndrome(x: np.ndarray) -> np.ndarray:
    """0 for a codeword, else the position (from 1) of the bit to flip to reach the only codeword within 1."""
    return _SYNDROME[0][x & 0xFFFF] ^ _SYNDROME[1][x >> 16 & 0x7FFF]


def home(x: np.ndarray) -> np.ndarray:
    s = syndrome(x)
    return np.where(s > 0, x ^ (np.uint32(1) << (np.maximum(s, 1) - 1).astype(np.uint32)), x) & np.uint32(0x7FFFFFFF)


def anchors_within(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of every codeword within distance 2 of each 31-bit point.

    Two flips reach a codeword where the flipped positions' XOR is the syndrome.
    """
    x = x & np.uint32(0x7FFFFFFF)
    s = syndrome(x)
    rows, found = [np.arange(len(x))], [home(x)]
    for i in range(1, 32):
        j = s ^ i
        ok = np.flatnonzero((j > i) & (s > 0))
        rows.append(ok)
        found.append(x[ok] ^ np.uint32(1 << (i - 1)) ^ (np.uint32(1) << (j[ok] - 1).astype(np.uint32)))
    return np.concatenate(rows), np.concatenate(found)


def _near(home_fp, home_id, probe_fp, probe_id, threshold, forest) -> None:
    """Joins the ids of all close pairs between the two sides, a block at a time."""
    step = max(1, PAIRS // max(1, len(home_fp)))
    for at in range(0, len(probe_fp), step):
        i, j = np.nonzero(np.bitwise_count(probe_fp[at : at + step, None] ^ home_fp[None, :]) <= threshold)
        forest.add(probe_id[at + i], home_id[j])


def _compare(kind: np.ndarray, anchor: np.ndarray, fp: np.ndarray, ident: np.ndarray, threshold: int, forest: Forest) -> None:
    """kind 1: filed at the anchor, 0: replicated to it."""
    order = np.lexsort((-kind.astype(np.int8), anchor))
    kind, anchor, fp, ident = kind[order], anchor[order], fp[order], ident[order]
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.append(starts, len(anchor)))
    filed = np.add.reduceat(kind.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    work = filed * sizes
    small = (work > 0) & (sizes > 1) & (work <= 4096)
    # Groups of little work are paired together, as many as PAIRS allows.
    at = np.flatnonzero(small)
    total = np.cumsum(work[at])
    for lo, hi in _runs(total, PAIRS):
        g = at[lo:hi]
        n = work[g]
        base = np.repeat(np.cumsum(n) - n, n)
        k = np.arange(n.sum()) - base
        width, first = np.repeat(sizes[g], n), np.repeat(starts[g], n)
        x, y = first + k // width, first + k % width
        ok = np.bitwise_count(fp[x] ^ fp[y]) <= threshold
        ok &= x != y
        forest.add(ident[x[ok]], ident[y[ok]])
    for g in np.flatnonzero((work > 4096) & (sizes > 1)):
        a, b, c = starts[g], starts[g] + filed[g], starts[g] + sizes[g]
        _near(fp[a:b], ident[a:b], fp[a:c], ident[a:c], threshold, forest)


def _runs(total: np.ndarray, most: int):
    at = 0
    while at < len(total):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        yield at, to
        at = to


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit number.  Rows keep their ids, null ids and repeats included."""
    cl.ship(docs.sparkSession)

    def scan(tables):
        for batch in tables:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            fp = np.array([fingerprint(t) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(scan, "id long, fp long")


def near_links(points: DataFrame, threshold: int = 3) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of points (node, fp) within `threshold` (at most 3) bits."""
    if not 0 <= threshold <= 3:
        raise ValueError("two halves of 32 bits find at most 3 differing bits")
    cl.ship(points.sparkSession)
    parts = cl.shuffle_partitions(points.sparkSession)

    def replicate(tables):
        for batch in tables:
            ident = batch.column(0).to_numpy()
            fp = batch.column(1).to_numpy().view(np.uint64)
            for half in range(2):
                x = ((fp >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
                rows, found = anchors_within(x)
                own = home(x)[rows] == found
                key = found.astype(np.int64) << 1 | half
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(ident[rows]), pa.array(fp[rows].view(np.int64))], names=["anchor", "filed", "node", "fp"])

    def compare(tables):
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in tables if b.num_rows]
        forest = Forest()
        if got:
            anchor, filed, node, fp = (np.concatenate(x) for x in zip(*got, strict=True))
            _compare(filed.astype(np.int8), anchor, fp.view(np.uint64), node, threshold, forest)
        a, b = forest.links()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sent = points.select("node", "fp").mapInArrow(replicate, "anchor long, filed boolean, node long, fp long")
    return sent.repartition(parts, "anchor").mapInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 3) -> DataFrame:
    """(id, fp, component): groups of texts whose fingerprints are linked by `threshold` or fewer differing bits.

    Texts are lower-cased in A-Z and cut into words and 3-word shingles.  Null
    and empty texts have fingerprint zero and link like any other.  component is
    the smallest id reachable, its own included.  Rows with a null id keep a
    row and are in no group: their component is null, and they link nothing.
    Rows that share an id keep a row each.  Empty tables give empty results.
    """
    every = cl.cut(fingerprints(docs, id_col, text_col))
    unnamed = every.where("id is null").select("id", "fp", F.lit(None).cast("long").alias("component"))
    prints = every.where("id is not null")
    points = prints.groupBy("fp").agg(F.min("id").alias("node"))
    points = cl.cut(points)
    # A node stands for one fingerprint: an id met under two texts gets a number of its own per fingerprint.
    shared_ids = points.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if shared_ids:
        ranked = points.select(F.col("fp"), F.col("node").alias("least"), F.xxhash64("fp", "node").alias("node"))
    else:
        ranked = points.select("fp", F.col("node").alias("least"), "node")
    groups = components(near_links(ranked, threshold))
    found = ranked.join(groups, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("component"))
    if shared_ids:
        same = prints.join(found.select("fp", "component"), "fp").select("id", F.col("component").alias("c"))
        ties = components(same.groupBy("c").agg(F.min("id").alias("m")).join(same, "c").select(F.col("m").alias("a"), F.col("id").alias("b")))
        whole = prints.join(ties.select(F.col("node").alias("id"), F.col("component").alias("tie")), "id", "left")
        return whole.select("id", "fp", F.coalesce("tie", "id").alias("component")).unionByName(unnamed)
    return prints.join(found.select("fp", "component"), "fp").select("id", "fp", "component").unionByName(unnamed)


def dedup_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 3) -> DataFrame:
    """One row of docs per group, of the smallest id; of rows that repeat this id the one that sorts first.  Rows with a null id all stay."""
    groups = cl.cut(simhash_groups(docs, id_col, text_col, threshold))
    gone = groups.where("id != component").select(F.col("id").alias("_gone")).distinct()
    kept = docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    repeated = groups.where("id = component").groupBy(F.col("id").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    if not repeated.limit(1).count():
        return kept
    repeated = cl.cut(repeated)
    one = kept.join(repeated, kept[id_col] == repeated["_again"], "left_semi").groupBy(F.col(f"`{id_col}`").alias("_again")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return kept.join(repeated, kept[id_col] == repeated["_again"], "left_anti").unionByName(one.select("_row.*"))
