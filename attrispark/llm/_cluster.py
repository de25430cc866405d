"""Shared cluster plumbing of the corpus operators.

Nothing here looks at text.  It cuts lineage through the shared checkpoint
folder, deals documents into blocks, and runs the block -> slice -> block
exchange that several operators use.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrispark.functions.ship import ship  # noqa: F401



#: Uncompressed text of one block; a single longer document has a block of its own size.
BLOCK_BYTES = 8 << 20
#: Text whose keys one slice of a hash space answers for.
SLICE_BYTES = 32 << 20

REQUEST = "_blk int, _slc int, payload binary"
REPLY = "_slc int, _blk int, kind int, payload binary"


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of this machine only in local mode, where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    if "attrispark" not in _LOCAL:
        _LOCAL["attrispark"] = tempfile.mkdtemp(prefix="attrispark-")
        atexit.register(shutil.rmtree, _LOCAL["attrispark"], True)
    return _LOCAL["attrispark"]


_LOCAL: dict[str, str] = {}


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices_for(spark: SparkSession, total: int) -> int:
    """Slices of a hash space whose keys come from `total` bytes of text: as many as shuffles have partitions, and more where a slice would be too large for a task."""
    return max(shuffle_partitions(spark), -(-total // SLICE_BYTES))


def text_bytes(docs: DataFrame, text: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0)


def dealt(docs: DataFrame, id_col: str, total: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_blk int, _row struct): rows of docs dealt by the hash of their id into blocks of about block_bytes.

    All columns travel inside one struct, so no name can clash.
    """
    spark = docs.sparkSession
    blocks = max(shuffle_partitions(spark), -(-total // block_bytes))
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).cast("int").alias("_blk"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    )


def squeezed(blocks: DataFrame) -> DataFrame:
    """(_blk, blob): the rows of each block that a task reads together as one compressed Arrow stream.

    Takes about half the disk of row-wise shuffle files.
    """

    def squeeze(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            if not batch.num_rows:
                continue
            blk = batch.column(0).to_numpy()
            order = np.argsort(blk, kind="stable")
            row = batch.column(1).take(pa.array(order))
            cuts = np.flatnonzero(np.diff(blk[order])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blk)], strict=True):
                part = pa.concat_arrays([row.slice(lo, hi - lo)])
                sink = pa.BufferOutputStream()
                table = pa.table({"_row": part.take(pa.array(range(hi - lo), pa.int64()))})
                with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                    out.write_table(table)
                yield pa.RecordBatch.from_arrays([pa.array([int(blk[order[lo]])], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_blk", "blob"])

    return blocks.mapInArrow(squeeze, "_blk int, blob binary")


def release() -> None:
    """Gives memory that earlier groups have freed back to the system, so that a worker's size is that of one group."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU C library


def rows_of(table: pa.Table, id_col: str, text_col: str) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """A block's rows in a fixed order (id, then text; null ids last), their texts as UTF-8 and their ids.

    Shuffles deliver rows in any order; this order is the same in each pass.
    """
    release()
    if "blob" in table.column_names:
        table = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in table.column("blob")])
    row = table.column("_row").combine_chunks()
    if isinstance(row, pa.ChunkedArray):
        row = pa.concat_arrays(row.chunks) if row.num_chunks else pa.array([], row.type)
    flat = pa.Table.from_arrays(row.flatten(), schema=pa.schema(list(row.type)))
    texts = flat.column(text_col).cast(pa.large_binary()).to_pylist()
    ids = flat.column(id_col).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, texts[i] or b""))
    flat = flat.take(pa.array(order, pa.int64()))
    numbers = np.array([np.iinfo(np.int64).max if ids[i] is None else ids[i] for i in order], np.int64)
    return flat, [texts[i] or b"" for i in order], numbers


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each 64-bit hash: equal ranges of its upper half, so hash order runs through the slices in order."""
    return ((h >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def by_slice(h: np.ndarray, slices: int) -> list[tuple[int, int, int]]:
    """(slice, from, to) of the nonempty slices of the sorted hashes h."""
    s = slice_of(h, slices)
    if not len(s):
        return []
    cut_at = np.flatnonzero(np.diff(s)) + 1
    lo = np.concatenate([[0], cut_at])
    hi = np.concatenate([cut_at, [len(s)]])
    return list(zip(s[lo].tolist(), lo.tolist(), hi.tolist(), strict=True))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes (the near-constant upper bytes compress away), then zstd."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else a.view(np.uint8)
        head = f"{a.dtype.str} {len(a)}\n".encode()
        out.append(head + np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(raw):
        end = raw.index(b"\n", at)
        kind, n = raw[at:end].split()
        dtype, n = np.dtype(kind.decode()), int(n)
        size = dtype.itemsize * n
        planes = np.frombuffer(raw, np.uint8, size, end + 1).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at = end + 1 + size
    return out


def deltas(h: np.ndarray) -> np.ndarray:
    """Gaps of sorted unsigned numbers in the narrowest type that holds them."""
    d = np.diff(h, prepend=h[:1]) if len(h) else h
    if len(h):
        d[0] = 0
    most = int(d.max()) if len(d) else 0
    return d.astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def undelta(first: int, d: np.ndarray) -> np.ndarray:
    return np.uint64(first) + np.cumsum(d.astype(np.uint64), dtype=np.uint64)


def requests_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"_blk": pa.array([r[0] for r in rows], pa.int32()), "_slc": pa.array([r[1] for r in rows], pa.int32()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def replies_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table(
        {
            "_slc": pa.array([r[0] for r in rows], pa.int32()),
            "_blk": pa.array([r[1] for r in rows], pa.int32()),
            "kind": pa.array([r[2] for r in rows], pa.int32()),
            "payload": pa.array([r[3] for r in rows], pa.binary()),
        }
    )


def requests_of(table: pa.Table) -> list[tuple[int, list[np.ndarray]]]:
    """(block, arrays) of a slice's requests in block order."""
    release()
    rows = sorted(zip(table.column("_blk").to_pylist(), table.column("payload").to_pylist(), strict=True), key=lambda r: r[0])
    return [(b, unpack(p)) for b, p in rows]


def replies_of(table: pa.Table, kind: int) -> dict[int, list[np.ndarray]]:
    """The arrays of each slice's reply to this block."""
    return {s: unpack(p) for s, k, p in zip(table.column("_slc").to_pylist(), table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True) if k == kind}


def ask(blocks: DataFrame, fn) -> DataFrame:
    """Requests of every block to the slices of a hash space."""
    return blocks.groupBy("_blk").applyInArrow(fn, REQUEST)


def answer(requests: DataFrame, fn) -> DataFrame:
    """Replies of every slice to the blocks that asked."""
    return requests.groupBy("_slc").applyInArrow(fn, REPLY)


def told(blocks: DataFrame, replies: DataFrame, fn, schema) -> DataFrame:
    """Every block together with the replies it got."""
    return blocks.groupBy("_blk").cogroup(replies.groupBy("_blk")).applyInArrow(fn, schema)
