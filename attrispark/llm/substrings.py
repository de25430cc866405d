"""Substring dedup by a count-min prefilter and an exact second pass.

Pass 1: every block of documents sketches its word windows into DEPTH rows of a
count-min sketch; the partial sketches travel as gap-coded cell lists, are
merged per range of cells, and each block gets back one bit per cell: counted
at least twice or not.  A count-min sketch only overestimates, so no repeated
window is lost.  Pass 2: windows that every row estimates repeated are grouped
by a 96-bit digest, the smallest document id of each group wins, and each block
gets back one bit per window it asked about.

No step gathers one window's occurrences: a block sends each of its windows
once however often it has it, so a window that every document holds costs one
row per block.  The sketch has about eight cells per window whatever the size
of the input and is never broadcast.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _cluster as cl
from . import _words as w

DEPTH = 2
COMPUTED = ("kept_text", "n_words", "n_removed")


def _scan(texts: list[bytes], size: int):
    """Word hashes, the text of each word, the first word of each complete window and the windows' hashes."""
    hashes, owner, places, windows, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for first, _, data, offsets in w.batches(texts):
        starts, ends, doc = w.words(data, offsets)
        h = w.word_hashes(data, starts, ends)
        if len(h) >= size:
            at = np.flatnonzero(doc[: len(h) - size + 1] == doc[size - 1 :])
            places.append(at + words)
            windows.append(w.window_hashes(h, size)[at])
        hashes.append(h)
        owner.append((doc + first).astype(np.int32))
        words += len(h)
    return tuple(np.concatenate(x) for x in (hashes, owner, places, windows))


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = keys if row == 0 else w.mix(keys ^ np.uint64(0x5851F42D4C957F2D))
    return mixed >> np.uint64(64 - bits)


def _sketch(keys: np.ndarray, counts: np.ndarray, bits: int):
    """Per row: the sorted distinct cells, whether this block alone counts two or more there, and each key's place among them."""
    for row in range(DEPTH):
        cells, place = np.unique(_cells(keys, row, bits), return_inverse=True)
        yield cells, np.bincount(place, weights=counts, minlength=len(cells)) >= 2, place


def _estimated(keys, counts, bits, slices, replies) -> np.ndarray:
    """Which of the block's distinct windows the merged sketch counts twice or more in every row."""
    heavy = np.ones(len(keys), bool)
    for row, (cells, _, place) in enumerate(_sketch(keys, counts, bits)):
        bit = np.zeros(len(cells), bool)
        for s, lo, hi in cl.by_slice(cells << np.uint64(64 - bits), slices):
            bit[lo:hi] = np.unpackbits(replies[s][row], count=hi - lo).astype(bool)
        heavy &= bit[place]
    return heavy


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Removes every word covered by a `window`-word run that also starts earlier.

    Earlier: in a row of smaller id, or at an earlier word of the same row.
    Returns the columns of docs with kept_text (kept words joined by one
    space), n_words and n_removed; columns of docs with these names give way.
    Null and empty texts have no words and an empty kept_text; a text shorter
    than the window keeps all words.  Rows that share an id count in the order
    of their texts; a null id counts as the largest.  Empty tables give empty
    results.
    """
    spark = docs.sparkSession
    cl.ship(spark)
    total = cl.text_bytes(docs, text_col)
    slices = cl.slices_for(spark, total)
    bits = min(60, max(12, total.bit_length()))
    blocks = cl.dealt(docs, id_col, total)
    out = T.StructType([f for f in docs.schema.fields if f.name not in COMPUTED] + [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def distinct(texts):
        h, doc, at, keys = _scan(texts, window)
        unique, first, place, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        return h, doc, at, unique, first, place, counts

    def sketch(table: pa.Table) -> pa.Table:
        _, texts, _ = cl.rows_of(table, id_col, text_col)
        *_, unique, _, _, counts = distinct(texts)
        block = table.column("_blk")[0].as_py()
        parts: dict[int, list[np.ndarray]] = {}
        for row, (cells, twice, _) in enumerate(_sketch(unique, counts, bits)):
            for s, lo, hi in cl.by_slice(cells << np.uint64(64 - bits), slices):
                mine = parts.setdefault(s, [np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint8)] * DEPTH)
                mine[3 * row : 3 * row + 3] = [cells[lo : lo + 1], cl.deltas(cells[lo:hi]), np.packbits(twice[lo:hi])]
        return cl.requests_table([(block, s, cl.pack(*p)) for s, p in parts.items()])

    def merge(table: pa.Table) -> pa.Table:
        s = table.column("_slc")[0].as_py()
        asked = [(b, [(cl.undelta(int(p[i][0]), p[i + 1]), np.unpackbits(p[i + 2], count=len(p[i + 1]))) if len(p[i]) else (np.zeros(0, np.uint64), np.zeros(0, np.uint8)) for i in range(0, 3 * DEPTH, 3)]) for b, p in cl.requests_of(table)]
        found = {b: [] for b, _ in asked}
        for row in range(DEPTH):
            present = [rows[row][0] for _, rows in asked if len(rows[row][0])]
            low = min((int(c[0]) for c in present), default=0)
            count = np.zeros(max((int(c[-1]) for c in present), default=0) - low + 1, np.uint8)
            for _, rows in asked:  # a block lists each cell once
                cells, twice = rows[row]
                at = (cells - np.uint64(low)).astype(np.int64)
                count[at] = np.minimum(count[at] + 1 + twice, 2)
            for b, rows in asked:
                found[b].append(np.packbits(count[(rows[row][0] - np.uint64(low)).astype(np.int64)] >= 2))
        return cl.replies_table([(s, b, 1, cl.pack(*m)) for b, m in found.items()])

    def candidates(table, replies):
        row, texts, ids = cl.rows_of(table, id_col, text_col)
        h, doc, at, unique, first, place, counts = distinct(texts)
        heavy = np.flatnonzero(_estimated(unique, counts, bits, slices, cl.replies_of(replies, 1)))
        return row, texts, ids, h, doc, at, unique, first, place, heavy

    def group(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return cl.requests_table([])
        _, _, ids, h, doc, at, unique, first, _, heavy = candidates(table, replies)
        keys, begin = unique[heavy], at[first[heavy]]
        check = w.window_hashes(h, window, second=True)[begin].astype(np.uint32) if len(begin) else np.zeros(0, np.uint32)
        owner, rows = ids[doc[begin]], []
        for s, lo, hi in cl.by_slice(keys, slices):
            known, which = np.unique(owner[lo:hi], return_inverse=True)
            rows.append((table.column("_blk")[0].as_py(), s, cl.pack(keys[lo : lo + 1], cl.deltas(keys[lo:hi]), check[lo:hi], known, which.astype(np.uint16 if len(known) < 1 << 16 else np.uint32))))
        return cl.requests_table(rows)

    def exact(table: pa.Table) -> pa.Table:
        s = table.column("_slc")[0].as_py()
        asked = cl.requests_of(table)
        keys = np.concatenate([cl.undelta(int(p[0][0]), p[1]) for _, p in asked])
        check = np.concatenate([p[2] for _, p in asked])
        owner = np.concatenate([p[3][p[4]] for _, p in asked])
        order = np.lexsort((owner, check, keys))
        leads = np.ones(len(order), bool)
        leads[1:] = (keys[order][1:] != keys[order][:-1]) | (check[order][1:] != check[order][:-1])
        earliest = np.zeros(len(order), bool)
        earliest[order] = leads
        rows, at = [], 0
        for b, p in asked:
            rows.append((s, b, 2, cl.pack(np.packbits(earliest[at : at + len(p[1])]))))
            at += len(p[1])
        return cl.replies_table(rows)

    from pyspark.sql.pandas.types import to_arrow_type as to_arrow

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], to_arrow(f.dataType)) for f in out.fields})
        row, texts, _, _, doc, at, unique, first, place, heavy = candidates(table, replies)
        last = cl.replies_of(replies, 2)
        earliest = np.ones(len(unique), bool)  # of its window's occurrences, one in this block is the first of all
        for s, lo, hi in cl.by_slice(unique[heavy], slices):
            earliest[heavy[lo:hi]] = np.unpackbits(last[s][0], count=hi - lo).astype(bool)
        fresh = np.zeros(len(at), bool)
        fresh[first[earliest]] = True
        again = at[~fresh]
        cover = np.zeros(len(doc) + window + 1, np.int32)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + window, -1)
        keep = np.cumsum(cover)[: len(doc)] == 0
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        kept, removed = [], []
        for i, text in enumerate(texts):
            mine = keep[bounds[i] : bounds[i + 1]]
            found = text.split()
            kept.append(b" ".join(found if mine.all() else compress(found, mine.tolist())))
            removed.append(int(len(mine) - mine.sum()))
        cols = {"kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(np.diff(bounds)), "n_removed": pa.array(removed, pa.int64())}
        return pa.Table.from_arrays([cols[f.name] if f.name in cols else row.column(f.name) for f in out.fields], names=[f.name for f in out.fields])

    first = cl.answer(cl.ask(blocks, sketch), merge)
    second = cl.answer(cl.told(blocks, first, group, cl.REQUEST), exact)
    return cl.told(blocks, first.unionByName(second), remove, out)
