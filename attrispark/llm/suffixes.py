"""Exact byte-substring dedup by a common-prefix-aware distributed merge sort of sparse suffixes.

Every string of `length` bytes is charged to the suffix that starts at its
anchor: the leftmost least hash among its `gram`-byte substrings.  Equal
strings have their anchors at the same offset, so only anchored suffixes (one
in about (length - gram) / 2 positions) take part, and of those only the ones
whose leading gram occurs twice.

Each block sorts its suffixes, front-codes them (length of the prefix shared
with the one before, then the rest) and sends the runs to the slice of the
leading gram's hash.  A slice merges the runs with a loser tree that keeps,
for each string, the prefix known to be shared with the last winner and
compares only beyond it.  Neighbours that share the gram form a group in which
the exact repeated strings follow from common prefixes to the right of the
anchor and to the left of it.  Equal contexts are sent once per block, so a
passage held by every document costs a row per block and anchor.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _cluster as cl
from . import _words as w

LENGTH, GRAM = 400, 128
#: Groups of more different contexts than this are resolved by counting strings offset by offset, not by pairs.
PAIRWISE = 64
#: Text of a block; its contexts are Python objects while they are sorted.
BLOCK_BYTES = 4 << 20
COMPUTED = ("kept_bytes", "n_bytes", "n_removed", "n_spans")
_PLACE = (1 << 24) - 1


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).reshape(-1)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _pieces(texts: list[bytes], length: int):
    """Like batches, but a text beyond CHUNK comes in pieces that share length - 1 bytes: (first text, piece start, bytes, offsets)."""
    for first, _, data, offsets in w.batches(texts):
        if len(data) <= 2 * w.CHUNK:
            yield first, 0, data, offsets
        else:
            owner = first + int(np.diff(offsets).argmax())  # the one text of the batch that isn't empty
            for at in range(0, len(data) - length + 1, w.CHUNK):
                part = data[at : at + w.CHUNK + length - 1]
                yield owner, at, part, np.array([0, len(part)])


def anchors(texts: list[bytes], length: int, gram: int):
    """(text, anchor, least and greatest offset of the anchor in its strings, hash of its gram), as arrays."""
    out = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]]
    for first, begin, data, offsets in _pieces(texts, length):
        n = len(data) - length + 1
        if n <= 0:
            continue
        g = w.byte_window_hashes(data, gram)
        key = (g & np.uint64((1 << 64) - 1 - _PLACE)) | np.arange(len(g), dtype=np.uint64)
        at = (sliding_least(key, length - gram + 1)[:n] & np.uint64(_PLACE)).astype(np.int64)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = owner[:n] == owner[length - 1 :]
        p = np.flatnonzero(inside)
        if not len(p):
            continue
        a, o = at[p], owner[p]
        lead = np.ones(len(p), bool)
        lead[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
        lo = np.flatnonzero(lead)
        hi = np.append(lo[1:], len(p)) - 1
        a, o = a[lo], o[lo]
        # Anchors are least hashes: mixed again they spread over all slices.
        out.append([o + first, a - offsets[o] + begin, a - p[hi], a - p[lo], w.mix(g[a])])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b)) - known
    x, y = a[known : known + n], b[known : known + n]
    if x == y:
        return known + n
    return known + n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (suffix, tie, payload) whose common prefixes with the item before are given.

    Iterating gives (common prefix with the item given before, item).
    """

    def __init__(self, runs: list[list[tuple]], prefixes: list[list[int]]):
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        none = [[] for _ in range(self.size - len(runs))]
        self.runs, self.prefixes = [*runs, *none], [*prefixes, *none]
        self.next = [0] * self.size
        self.head = [r[0] if r else None for r in self.runs]
        self.known = [0] * self.size  # prefix that each head shares with the last winner
        self.loser = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            winners[node], self.loser[node] = self.play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1]

    def play(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows what it shares with the winner."""
        a, b = self.head[x], self.head[y]
        if a is None:
            return y, x
        if b is None:
            return x, y
        kx, ky = self.known[x], self.known[y]
        if kx != ky:
            return (x, y) if kx > ky else (y, x)
        k = shared(a[0], b[0], kx)
        if k == len(a[0]) == len(b[0]):
            first = a[1] <= b[1]
        elif k == len(a[0]) or k == len(b[0]):
            first = k == len(a[0])
        else:
            first = a[0][k] < b[0][k]
        if first:
            self.known[y] = k
            return x, y
        self.known[x] = k
        return y, x

    def __iter__(self):
        while self.head[self.winner] is not None:
            i = self.winner
            yield self.known[i], self.head[i]
            self.next[i] += 1
            at, run = self.next[i], self.runs[i]
            if at < len(run):
                self.head[i], self.known[i] = run[at], self.prefixes[i][at]
            else:
                self.head[i] = None
            node = (i + self.size) // 2
            while node:
                i, self.loser[node] = self.play(i, self.loser[node])
                node //= 2
            self.winner = i


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same whole numbers in the fewest intervals."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def repeated_offsets(group: list[tuple], prefixes: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each context of a group in suffix order, the intervals of anchor offsets whose strings occur in another context.

    A context is (suffix, reversed left part, held twice); equal ones are neighbours.
    prefixes[i]: what suffix i shares with suffix i - 1.
    """
    n = len(group)
    full = [x[2] for x in group]
    kinds: list[int] = []
    for i in range(n):
        if kinds and group[i][0] == group[kinds[-1]][0] and group[i][1] == group[kinds[-1]][1]:
            full[i] = full[kinds[-1]] = True
            full[i - 1] = True
        else:
            kinds.append(i)
    own = [(length - len(x[0]), len(x[1])) for x in group]
    found: list[list[tuple[int, int]]] = [[own[i]] if full[i] else [] for i in range(n)]
    open_kinds = [i for i in kinds if not full[i]]
    if not open_kinds or len(kinds) < 2:
        return found
    if len(kinds) <= PAIRWISE:
        gap = [min(prefixes[a + 1 : b + 1]) for a, b in zip(kinds, kinds[1:], strict=False)]
        for j, x in enumerate(kinds):
            right = length
            for y, step in zip(kinds[j + 1 :], gap[j:], strict=False):
                right = min(right, step)
                if full[x] and full[y]:
                    continue
                least = max(length - right, own[x][0], own[y][0])
                most = min(own[x][1], own[y][1])
                if least > most:
                    continue
                most = min(most, shared(group[x][1], group[y][1]))
                if least <= most:
                    for z in (x, y):
                        if not full[z]:
                            found[z].append((least, most))
        for x in open_kinds:
            found[x] = united(found[x])
        return found
    context = {i: (group[i][1][::-1] + group[i][0], len(group[i][1])) for i in kinds}
    for offset in range(min(own[i][0] for i in kinds), max(own[i][1] for i in kinds) + 1):
        strings = {i: context[i][0][context[i][1] - offset : context[i][1] - offset + length] for i in kinds if own[i][0] <= offset <= own[i][1]}
        times = Counter(strings.values())
        for i, s in strings.items():
            if times[s] > 1 and not full[i]:
                if found[i] and found[i][-1][1] == offset - 1:
                    found[i][-1] = (found[i][-1][0], offset)
                else:
                    found[i].append((offset, offset))
    return found


def _front_code(rows: list[tuple[bytes, bytes, bool]]) -> bytes:
    lcp, rest, back, left = [], [], [], []
    before = (b"", b"", False)
    for x in rows:
        k, b = shared(before[0], x[0]), shared(before[1], x[1])
        lcp.append(k)
        rest.append(x[0][k:])
        back.append(b)
        left.append(x[1][b:])
        before = x
    u16 = lambda v: np.array(v, np.uint32)
    return cl.pack(u16(lcp), u16([len(x) for x in rest]), u16(back), u16([len(x) for x in left]), np.array([x[2] for x in rows], np.uint8), np.frombuffer(b"".join(rest), np.uint8), np.frombuffer(b"".join(left), np.uint8))


def _decode(arrays: list[np.ndarray]) -> tuple[list[tuple[bytes, bytes, bool]], list[int]]:
    lcp, n_rest, back, n_left, twice = (x.tolist() for x in arrays[:5])
    rest, left, i, j, rows, a, b = arrays[5].tobytes(), arrays[6].tobytes(), 0, 0, [], b"", b""
    for k, n, m, l, t in zip(lcp, n_rest, back, n_left, twice, strict=True):
        a, b = a[:k] + rest[i : i + n], b[:m] + left[j : j + l]
        i, j = i + n, j + l
        rows.append((a, b, bool(t)))
    return rows, lcp


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Removes every byte covered by a `length`-byte string that also starts anywhere else.

    Returns the columns of docs with kept_bytes (the remaining UTF-8 bytes,
    which may cut a character), n_bytes, n_removed and n_spans (maximal removed
    runs); columns of docs with these names give way.  Null texts count as
    empty.  Texts shorter than `length` are kept whole.  Repeated rows repeat
    each other.  Empty tables give empty results.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    spark = docs.sparkSession
    cl.ship(spark)
    total = cl.text_bytes(docs, text_col)
    slices = cl.slices_for(spark, total)
    blocks = cl.squeezed(cl.dealt(docs, id_col, total, BLOCK_BYTES))
    long = T.LongType()
    out = T.StructType([f for f in docs.schema.fields if f.name not in COMPUTED] + [T.StructField("kept_bytes", T.BinaryType()), T.StructField("n_bytes", long), T.StructField("n_removed", long), T.StructField("n_spans", long)])

    def grams(table: pa.Table) -> pa.Table:
        _, texts, _ = cl.rows_of(table, id_col, text_col)
        *_, g = anchors(texts, length, gram)
        keys, counts = np.unique(g, return_counts=True)
        block = table.column("_blk")[0].as_py()
        return cl.requests_table([(block, s, cl.pack(keys[lo : lo + 1], cl.deltas(keys[lo:hi]), np.packbits(counts[lo:hi] > 1))) for s, lo, hi in cl.by_slice(keys, slices)])

    def counted(table: pa.Table) -> pa.Table:
        s = table.column("_slc")[0].as_py()
        asked = cl.requests_of(table)
        keys = np.concatenate([cl.undelta(int(p[0][0]), p[1]) for _, p in asked])
        twice = np.concatenate([np.unpackbits(p[2], count=len(p[1])) for _, p in asked])
        _, place = np.unique(keys, return_inverse=True)
        again = (np.bincount(place, weights=1 + twice) > 1)[place]
        rows, at = [], 0
        for b, p in asked:
            rows.append((s, b, 1, cl.pack(np.packbits(again[at : at + len(p[1])]))))
            at += len(p[1])
        return cl.replies_table(rows)

    def contexts(table: pa.Table, replies: pa.Table):
        """By slice, the different contexts of repeated grams in suffix order, each with its places."""
        row, texts, _ = cl.rows_of(table, id_col, text_col)
        doc, at, least, most, g = anchors(texts, length, gram)
        keys, place = np.unique(g, return_inverse=True)
        again, answers = np.zeros(len(keys), bool), cl.replies_of(replies, 1)
        for s, lo, hi in cl.by_slice(keys, slices):
            again[lo:hi] = np.unpackbits(answers[s][0], count=hi - lo).astype(bool)
        mine = np.flatnonzero(again[place])
        runs: dict[int, dict[tuple[bytes, bytes], list[tuple[int, int]]]] = {}
        for s, d, a, lo, hi in zip(cl.slice_of(g[mine], slices).tolist(), doc[mine].tolist(), at[mine].tolist(), least[mine].tolist(), most[mine].tolist(), strict=True):
            text = texts[d]
            runs.setdefault(s, {}).setdefault((text[a : a + length - lo], text[a - hi : a][::-1]), []).append((d, a))
        return row, texts, {s: sorted(r.items()) for s, r in runs.items()}

    def sort(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return cl.requests_table([])
        _, _, runs = contexts(table, replies)
        block = table.column("_blk")[0].as_py()
        return cl.requests_table([(block, s, _front_code([(*c, len(places) > 1) for c, places in r])) for s, r in runs.items()])

    def merge(table: pa.Table) -> pa.Table:
        s = table.column("_slc")[0].as_py()
        asked = [(b, _decode(p)) for b, p in cl.requests_of(table)]
        runs = [[(*x, k, i) for i, x in enumerate(rows)] for k, (_, (rows, _)) in enumerate(asked)]
        found: list[list[tuple[int, int, int]]] = [[] for _ in asked]

        def resolve(group, prefixes):
            if len(group) > 1 or group and group[0][2]:
                for x, spans in zip(group, repeated_offsets([y[:3] for y in group], prefixes, length), strict=True):
                    found[x[3]] += [(x[4], lo, hi) for lo, hi in spans]

        group, prefixes = [], []
        for k, item in LoserTree(runs, [lcp for _, (_, lcp) in asked]):
            if group and k < gram:
                resolve(group, prefixes)
                group, prefixes = [], []
            group.append(item)
            prefixes.append(k)
        resolve(group, prefixes)
        return cl.replies_table([(s, b, 2, cl.pack(*np.array(found[k], np.uint32).reshape(-1, 3).T)) for k, (b, _) in enumerate(asked)])

    from pyspark.sql.pandas.types import to_arrow_type as to_arrow

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], to_arrow(f.dataType)) for f in out.fields})
        row, texts, runs = contexts(table, replies)
        answers = cl.replies_of(replies, 2)
        cover = [None] * len(texts)
        for s, r in runs.items():
            for i, lo, hi in zip(*(x.tolist() for x in answers[s]), strict=True) if s in answers and len(answers[s]) == 3 else ():
                for d, a in r[i][1]:
                    if cover[d] is None:
                        cover[d] = np.zeros(len(texts[d]) + 1, np.int32)
                    cover[d][a - hi] += 1
                    cover[d][a - lo + length] -= 1
        kept, removed, spans = [], [], []
        for text, c in zip(texts, cover, strict=True):
            if c is None:
                kept.append(text)
                removed.append(0)
                spans.append(0)
            else:
                gone = np.cumsum(c)[:-1] > 0
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
        cols = {"kept_bytes": pa.array(kept, pa.binary()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
        return pa.Table.from_arrays([cols[f.name] if f.name in cols else row.column(f.name) for f in out.fields], names=[f.name for f in out.fields])

    first = cl.answer(cl.ask(blocks, grams), counted)
    second = cl.answer(cl.told(blocks, first, sort, cl.REQUEST), merge)
    return cl.told(blocks, first.unionByName(second), remove, out)
