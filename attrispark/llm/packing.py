"""Best-fit packing of token pieces after a Martello-Toth dominance reduction.

Documents are tokenised where they are read: the different words of some MB of
text are looked up in a bounded cache, and ids are laid out by array takes; only (id, piece, length, checksum) rows move.  Rows are dealt into
bundles of bounded size by hash, and each bundle is packed on its own, so no
task grows with the input; a bundle wastes at most a part of one sequence more
than a global packing.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _cluster as cl

CAPACITY = 4096
END_ID = 1
#: Pieces in a bundle at most; a bundle's rows fit a small part of a task's memory.
BUNDLE = 1 << 16
BUNDLE_WITH_IDS = 1 << 12
#: Words whose ids a worker remembers, and bytes of text whose words are looked up together.
CACHE, TEXT_BYTES = 250_000, 6 << 20
#: Words that the tokenizer is given in one string, and what stands between them: a special token, found before anything else.
JOINED, BETWEEN = 1000, b"<|endoftext|>"

#: The only normalizer and split that the short way below stands for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_MARKS = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"))
_DIGITS = np.isin(np.arange(256), list(b"0123456789"))
_LETTERS = np.isin(np.arange(256), [*b"abcdefghijklmnopqrstuvwxyz", 0xC3, 0xC4, 0xC5])


def _bytes(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words, and where each word begins among them (one more than there are words)."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset) if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _letters(data: np.ndarray) -> np.ndarray:
    """Of each byte: whether it is of a to z, or of a letter from U+00C0 to U+017F whose small form is a single letter.

    The first byte of a character says so too soon; its second one is right.
    """
    before = np.append(np.zeros(1, np.uint8), data)[:-1]
    second = (before == 0xC3) & (data != 0x97) & (data != 0xB7) | (before == 0xC4) & (data != 0xB0) | (before == 0xC5)
    return _LETTERS[data] | second


def _any(where: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each word: whether any of its bytes is marked."""
    found = np.zeros(len(offsets) - 1, bool)
    found[np.searchsorted(offsets, np.flatnonzero(where), side="right") - 1] = True
    return found


class WordIds:
    """Ids of words, by the number of each word met: number 0 is the empty one.

    The tokenizer drops white space and never joins characters across it, so a
    text's ids are those of its words one after the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(BETWEEN.decode())
        self.short = self._short()
        self.clear()

    def _short(self):
        """The same model for words of small letters alone, which the normalizer and the split leave as they are; None for other kinds of tokenizers.

        Neither keeps a cache: each word comes once.  A word's last id is one that ends with the model's suffix, and only that.
        """
        from tokenizers import Tokenizer, models, pre_tokenizers

        config = json.loads(self.tokenizer.to_str())
        model = config["model"]
        if config["normalizer"] != _NORMALIZER or config["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}:
            return None
        if model["type"] != "BPE" or {k for k, v in model.items() if v} != {"type", "vocab", "merges", "end_of_word_suffix"} or not all("<" in t["content"] for t in config["added_tokens"]):
            return None
        suffix = model["end_of_word_suffix"]
        bpe = models.BPE(model["vocab"], [tuple(m) for m in model["merges"]], cache_capacity=0, end_of_word_suffix=suffix)
        self.tokenizer.model = bpe
        short = Tokenizer(bpe)
        short.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.last[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        return short

    def clear(self) -> None:
        self.words = pa.array([b""], pa.large_binary())
        self.ids = np.zeros(0, "<u4")
        self.size = np.zeros(1, np.int64)
        self.start = np.zeros(1, np.int64)

    def learn(self, words: pa.LargeBinaryArray) -> None:
        """Gives each of the new words a number."""
        data, offsets = _bytes(words)
        long = _any(~_letters(data), offsets) | (self.short is None)
        spelt, others = words.filter(pa.array(~long)), words.filter(pa.array(long))
        found, sizes = [], []
        data, offsets = _bytes(spelt)
        spaced = np.insert(data, offsets[1:], ord(" ")).tobytes()
        bounds = [*range(0, len(spelt), JOINED), len(spelt)]
        parts = [spaced[offsets[a] + a : offsets[b] + b - 1].decode().lower() for a, b in itertools.pairwise(bounds)]
        for a, b, e in zip(bounds, bounds[1:], self.short.encode_batch_fast(parts) if parts else [], strict=False):
            found.append(np.array(e.ids, "<u4"))
            sizes.append(np.diff(np.flatnonzero(self.last[found[-1]]), prepend=-1))
            if len(sizes[-1]) != b - a or sizes[-1].sum() != len(found[-1]):
                raise ValueError("the tokenizer's words don't end with its suffix")
        plain = self.between is not None
        listed = others.to_pylist()
        loose = [not plain or b"<|" in w for w in listed]
        joined = [w for w, x in zip(listed, loose, strict=True) if not x]
        parts = [joined[at : at + JOINED] for at in range(0, len(joined), JOINED)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([BETWEEN.join(p).decode() for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.between)
            found.append(np.delete(ids, ends))
            sizes.append(np.diff(ends, prepend=-1, append=len(ids)) - 1)
            if len(sizes[-1]) != len(part):
                raise ValueError("the tokenizer joins words across its special token")
        for e in self.tokenizer.encode_batch_fast([w.decode() for w, x in zip(listed, loose, strict=True) if x], add_special_tokens=False):
            found.append(np.array(e.ids, "<u4"))
            sizes.append(np.array([len(e.ids)]))
        size = np.concatenate(sizes)
        self.words = pa.concat_arrays([self.words, spelt, others.take(pa.array(np.argsort(loose, kind="stable")))])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *found])

    def of(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """Two numbers of each of the different words: its ids are those of the first, then those of the second.

        The tokenizer composes characters, then folds case.  Below U+0180
        nothing composes, so the order doesn't matter there; the names of
        special tokens are matched before either.  Marks that end a word after
        a letter or digit are cut from it by the tokenizer itself.
        """
        if len(self.words) > CACHE:
            self.clear()
        data, offsets = _bytes(words)
        odd = _any((data >= 0xC6) | (data == ord("<")), offsets)  # words with far characters, or that may name a special token
        upper = (data >= ord("A")) & (data <= ord("Z")) & ~np.repeat(odd, np.diff(offsets))
        data = data + upper.astype(np.uint8) * np.uint8(32)
        other = np.flatnonzero(~_MARKS[data])
        at = other[np.searchsorted(other, offsets[1:]) - 1] if len(other) else np.full(len(words), -1)  # the last byte that is no mark
        cut = ~odd & (at >= offsets[:-1]) & (at < offsets[1:] - 1)
        cut[cut] = (_letters(data) & (data < 0xC3) | _DIGITS[data])[at[cut]]
        bounds = np.append(np.stack([offsets[:-1], np.where(cut, at + 1, offsets[1:])], axis=1).reshape(-1), offsets[-1])
        halves = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(words), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        known = pc.index_in(halves.dictionary, value_set=self.words)
        if known.null_count:
            self.learn(halves.dictionary.filter(known.is_null()))
            known = pc.index_in(halves.dictionary, value_set=self.words)
        return known.to_numpy()[halves.indices.to_numpy()]

    def flat(self, numbers: np.ndarray) -> np.ndarray:
        return expand(self.ids, self.start[numbers], self.size[numbers])


def expand(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each pair, one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


_KNOWN: dict[str, WordIds] = {}


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts, each with the closing id, and where each begins (one more than there are texts)."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    known = _KNOWN[path]
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = split.flatten().dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    both = known.of(words.dictionary.cast(pa.large_binary()))
    # Of each different word: where its ids begin among those of all different words, and how many they are.
    distinct, size = known.flat(both), known.size[both].reshape(-1, 2).sum(axis=1)
    begin = np.cumsum(size) - size
    distinct, begin, size = np.append(distinct, np.uint32(END_ID)), np.append(begin, len(distinct)), np.append(size, 1)
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    at = np.insert(words.indices.to_numpy(), bounds[1:], len(size) - 1)  # a closing id after each text
    ends = bounds[1:] + np.arange(1, len(bounds))
    total = np.concatenate([[0], np.cumsum(size[at])])
    return expand(distinct, begin[at], size[at]), np.concatenate([[0], total[ends]])


def parts_of(texts: pa.Array, most: int = TEXT_BYTES):
    """Slices of texts of about `most` bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every row: its ids and the closing id, cut only where longer than capacity.

    Null and empty texts give one piece that holds the closing id.
    """
    cl.ship(docs.sparkSession)
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def cut_batch(batch):
        for at, texts in parts_of(batch.column(1)):
            ids, bounds = token_ids(texts, tokenizer_path)
            size = np.diff(bounds)
            pieces = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            raw, begin = memoryview(ids).cast("B"), 4 * (bounds[row] + start)
            spans = list(zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True))
            crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in spans), np.int64, len(row))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), *([pa.array([raw[a:b].tobytes() for a, b in spans], pa.binary())] if with_ids else [])], names=[f.name for f in fields])

    def cut(batches):
        cl.release()
        for batch in batches:
            yield from cut_batch(batch)
        batch = None
        cl.release()  # the worker stays, and what other tasks do comes on top of what it holds

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(cut, T.StructType(fields))


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes sets of up to three pieces that dominate every other set holding their largest piece j, and takes them out of counts.

    counts[l]: pieces of length l.  A set with j dominates all others with j
    if whatever else fits beside j could be swapped, part by part, for what it
    holds: {j, k} where k fills the rest exactly; {j} where nothing fits;
    {j, k} with the largest fitting k where no two pieces fit beside j, or where
    no three fit and no two hold more than k; {j, k, m} where no three fit, m is
    the largest that fits beside j and k, and no two pieces larger than m fit.
    Every length is tried, from the largest, until nothing more is dominated.
    Gives (lengths, times).
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    if counts[capacity]:
        fixed.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    for l in range(capacity - 1, (capacity - 1) // 2, -1):
        k = capacity - l
        n = int(counts[l] // 2 if k == l else min(counts[l], counts[k])) if k else 0
        if n:
            fixed.append(((l, k), n))
            counts[l] -= n
            counts[k] -= n
    changed = True
    while changed:
        changed = False
        least = _smallest(counts, 3)
        # Where three pieces fit beside j nothing can be said, so only lengths beyond this are tried.
        for j in np.flatnonzero(counts)[::-1].tolist():
            if len(least) == 3 and j <= capacity - sum(least):
                break
            while counts[j]:
                counts[j] -= 1
                beside = _dominating(counts, capacity - j)
                if beside is None:
                    counts[j] += 1
                    break
                for k in beside:
                    counts[k] -= 1
                fixed.append(((j, *beside), 1))
                changed = True
            least = _smallest(counts, 3)
    return fixed


def _smallest(counts: np.ndarray, most: int) -> list[int]:
    """The lengths of the `most` smallest pieces, repeats included."""
    found: list[int] = []
    for l in np.flatnonzero(counts)[:most].tolist():
        found += [l] * min(most - len(found), int(counts[l]))
        if len(found) == most:
            break
    return found


def _dominating(counts: np.ndarray, rest: int) -> tuple[int, ...] | None:
    """What to put into `rest` beside a piece so that no other choice is better, or None where that can't be told."""
    there = np.flatnonzero(counts[: rest + 1])
    if not len(there):
        return ()
    k = int(there[-1])
    few = _smallest(counts, 3)
    if k == rest or len(few) < 2 or few[0] + few[1] > rest:
        return (k,)
    if len(few) == 3 and sum(few) <= rest:
        return None
    lengths = [l for l in there.tolist() for _ in range(min(2, int(counts[l])))]
    lo, hi, best = 0, len(lengths) - 1, 0  # the most that two of them hold
    while lo < hi:
        if lengths[lo] + lengths[hi] > rest:
            hi -= 1
        else:
            best = max(best, lengths[lo] + lengths[hi])
            lo += 1
    if k >= best:
        return (k,)
    counts[k] -= 1
    fits = np.flatnonzero(counts[: rest - k + 1])
    counts[k] += 1
    if not len(fits):
        return None
    m = int(fits[-1])
    larger = [l for l in lengths if l > m]
    return (k, m) if len(larger) < 2 or larger[0] + larger[1] > rest else None


def best_fit(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes where it leaves the least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for l in np.flatnonzero(counts)[::-1].tolist():
        for _ in range(int(counts[l])):
            fits = rooms >> l
            if fits:
                room = l + (fits & -fits).bit_length() - 1
                stack = by_room[room]
                b = stack.pop()
                if not stack:
                    rooms ^= 1 << room
            else:
                room, b = capacity, len(bins)
                bins.append([])
            bins[b].append(l)
            room -= l
            if room:
                stack = by_room.setdefault(room, [])
                if not stack:
                    rooms |= 1 << room
                stack.append(b)
    return bins


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; equal lengths are taken in the given order."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = [list(s) for s, times in reduce_dominated(counts, capacity) for _ in range(times)]
    plan += best_fit(counts, capacity)
    order = np.argsort(-lengths, kind="stable")
    flat = np.array([l for s in plan for l in s], np.int64)
    owner = np.repeat(np.arange(len(plan)), [len(s) for s in plan])
    start = np.concatenate([[0], np.cumsum(flat)[:-1]]) if len(flat) else flat
    first = np.concatenate([[0], np.cumsum([len(s) for s in plan])[:-1]]).astype(np.int64) if plan else flat
    slot = np.argsort(-flat, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    sequence[order] = owner[slot]
    offset[order] = (start - start[first][owner])[slot] if len(flat) else flat
    return sequence, offset


def pack(rows: DataFrame, bundles: int, capacity: int = CAPACITY) -> DataFrame:
    """rows (id, piece, length, ...) with sequence_id and offset; places in a sequence are gapless from 0."""
    cl.ship(rows.sparkSession)
    dealt = rows.withColumn("_bundle", F.pmod(F.xxhash64("id", "piece"), F.lit(bundles)).cast("int"))
    out = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in rows.schema.fields]

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("piece", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = pack_lengths(table.column("length").to_numpy(), capacity)
        bundle = table.column("_bundle")[0].as_py()
        return table.select(names).append_column("sequence_id", pa.array(sequence + (bundle << 32))).append_column("offset", pa.array(offset))

    return dealt.groupBy("_bundle").applyInArrow(place, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs every row's tokens into sequences of at most `capacity`: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    Only texts longer than a sequence are cut.  Null and empty texts hold the
    closing id alone.  Rows that share an id are packed like any others; null
    ids stay null.  Empty tables give empty results.  Other columns of docs
    are not carried.
    """
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0)).alias("bytes")).first()
    most = size["n"] + size["bytes"] // capacity  # pieces: a token takes a byte or more
    bundles = max(1, -(-most // (BUNDLE_WITH_IDS if with_ids else BUNDLE)))
    return pack(pieces(docs, tokenizer_path, id_col, text_col, capacity, with_ids), bundles, capacity)
