"""Language identification: a bidirectional gated recurrent network over the bytes of a text.

Two recurrences read the bytes, one from each side, and every position is
labelled from what both have seen; a document's probabilities are the mean
over the positions of its letters.  The network is trained here, in numpy, by
backpropagation through time, on a bounded sample of labelled rows: one Spark
task draws its batches and returns the weights, some tens of kilobytes.  Texts
are then labelled whole, where they lie, in segments that are read side by
side, so memory follows neither a text's length nor the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _cluster as cl

#: Units of each direction, bytes of a segment (a recurrence starts anew in each), segments read side by side.
UNITS, SEGMENT, SIDE = 12, 128, 1024
#: Training: texts a language at most, snippets of a text, steps, segments a step, learning rate.
SAMPLE, SNIPPETS, STEPS, BATCH, RATE = 300, 3, 260, 64, 0.02
#: One document in FOLDS, by the CRC of its id, is held out of training.
FOLDS = 5
#: Languages beyond which the output layer isn't meant for.
MOST_LANGUAGES = 1000
#: Bytes of text that a task lays out at a time.
LAID = 4 << 20
UNKNOWN = "und"

_LETTER = np.zeros(256, np.float32)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_FAR = re.compile(rb"[\x80-\xff]")


@dataclass
class Net:
    """Weights by direction: of bytes (256, 3H), of the gates (2H, H), of the candidate (H, H), of the labels (L, H); label biases (L,)."""

    byte: np.ndarray
    gate: np.ndarray
    cand: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: int, units: int, rng: np.random.Generator) -> Net:
        normal = lambda *shape: (rng.normal(size=shape) / shape[-1] ** 0.5).astype(np.float32)
        return cls(normal(2, 256, 3 * units), normal(2, 2 * units, units), normal(2, units, units), normal(2, labels, units), np.zeros(labels, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.byte, self.gate, self.cand, self.out, self.bias]


def recur(net: Net, side: int, x: np.ndarray, h: np.ndarray):
    """One step of a direction: h' = h + z (c - h), with gates z, r = (1 + tanh) / 2 of the byte and h, and c = tanh of the byte and 2 r h.

    Returns h' and what the way back needs.
    """
    units = h.shape[0]
    a = np.ascontiguousarray(net.byte[side].take(x, axis=0).T)
    zr = net.gate[side] @ h
    zr += a[: 2 * units]
    np.tanh(zr, out=zr)
    reset = zr[units:] * h
    reset += h
    c = net.cand[side] @ reset
    c += a[2 * units :]
    np.tanh(c, out=c)
    z = zr[:units] + np.float32(1)
    z *= np.float32(0.5)
    return h + z * (c - h), (h, zr, reset, c, z)


def label(net: Net, x: np.ndarray) -> np.ndarray:
    """(labels, segments): each segment's position probabilities summed over its letters.  x: (positions, segments) of bytes."""
    length, side = x.shape
    units = net.cand.shape[1]
    seen = np.empty((length, units, side), np.float32)
    h = np.zeros((units, side), np.float32)
    for t in range(length):
        h, _ = recur(net, 0, x[t], h)
        seen[t] = h
    h = np.zeros((units, side), np.float32)
    pooled = np.zeros((len(net.bias), side), np.float32)
    for t in range(length - 1, -1, -1):
        h, _ = recur(net, 1, x[t], h)
        p = net.out[0] @ seen[t]
        p += net.out[1] @ h
        p += net.bias[:, None]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p *= _LETTER[x[t]] / p.sum(axis=0)
        pooled += p
    return pooled


def gradients(net: Net, x: np.ndarray, target: np.ndarray) -> tuple[float, Net]:
    """Mean cross-entropy of the letters' labels, and its gradient by backpropagation through time."""
    length, side = x.shape
    units, labels = net.cand.shape[1], len(net.bias)
    weight = _LETTER[x]
    weight = weight / max(1.0, float(weight.sum()))
    grad = Net(*[np.zeros_like(a) for a in net.arrays()])
    states = np.zeros((2, length, units, side), net.byte.dtype)
    kept: list[list] = [[None] * length, [None] * length]
    for d in (0, 1):
        h = np.zeros((units, side), net.byte.dtype)
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            h, kept[d][t] = recur(net, d, x[t], h)
            states[d, t] = h
    logits = np.einsum("lh,ths->tls", net.out[0], states[0]) + np.einsum("lh,ths->tls", net.out[1], states[1]) + net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    right = np.take_along_axis(p, np.broadcast_to(target, (length, 1, side)), axis=1)[:, 0]
    loss = float(-(weight * np.log(np.maximum(right, 1e-30))).sum())
    p[np.arange(length)[:, None], target[None, :], np.arange(side)[None, :]] -= 1
    p *= weight[:, None, :]
    grad.bias += p.sum(axis=(0, 2))
    for d in (0, 1):
        grad.out[d] = np.einsum("tls,ths->lh", p, states[d])
        into = np.einsum("lh,tls->ths", net.out[d], p)
        dh = np.zeros((units, side), net.byte.dtype)
        da = np.empty((length, 3 * units, side), net.byte.dtype)
        for t in range(length - 1, -1, -1) if d == 0 else range(length):
            h, zr, reset, c, z = kept[d][t]
            dh = dh + into[t]
            dc = dh * z * (1 - c * c)
            dreset = net.cand[d].T @ dc
            dzr = np.concatenate([dh * (c - h) * 0.5, dreset * h]) * (1 - zr * zr)
            grad.cand[d] += dc @ reset.T
            grad.gate[d] += dzr @ h.T
            da[t, : 2 * units], da[t, 2 * units :] = dzr, dc
            dh = dh * (1 - z) + dreset * (1 + zr[units:]) + net.gate[d].T @ dzr
        flat = x.reshape(-1)
        for k in range(3 * units):
            grad.byte[d, :, k] = np.bincount(flat, weights=da[:, k].reshape(-1), minlength=256)
    return loss, grad


def train(texts: list[list[bytes]], units: int = UNITS, steps: int = STEPS, seed: int = 0) -> Net:
    """A network for the snippets of each language; languages take turns, so none outweighs another."""
    rng = np.random.default_rng(seed)
    net = Net.fresh(len(texts), units, rng)
    first, second = ([np.zeros_like(a) for a in net.arrays()] for _ in range(2))
    for k in range(1, steps + 1):
        target = rng.permutation((np.arange(BATCH) + k * BATCH) % len(texts))
        longest = SEGMENT if k % 2 else int(rng.integers(16, SEGMENT))
        x = np.zeros((longest, BATCH), np.intp)
        for j, of in enumerate(target):
            snippet = texts[of][int(rng.integers(len(texts[of])))]
            size = min(len(snippet), longest if j % 4 else int(rng.integers(8, longest + 1)))
            at = int(rng.integers(len(snippet) - size + 1))
            x[:size, j] = np.frombuffer(snippet, np.uint8, size, at)
        _, grad = gradients(net, x, target)
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grad.arrays())))
        rate = RATE * min(1.0, 2 * (1 - (k - 1) / steps))
        for a, g, m, v in zip(net.arrays(), grad.arrays(), first, second, strict=True):
            g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-12)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return net


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    return bool(_FAR.search(text)) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _segments(texts: list[bytes]):
    """(text of each segment, segments as rows of bytes) for runs of about LAID bytes; texts are cut, never short of their end."""
    owner, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, len(text), LAID):
            piece = text[lo : lo + LAID]
            count = -(-len(piece) // SEGMENT)
            owner.append(np.full(count, i))
            parts.append(piece.ljust(count * SEGMENT, b"\0"))
            size += len(piece)
            if size >= LAID:
                yield np.concatenate(owner), np.frombuffer(b"".join(parts), np.uint8).reshape(-1, SEGMENT)
                owner, parts, size = [], [], 0
    if size:
        yield np.concatenate(owner), np.frombuffer(b"".join(parts), np.uint8).reshape(-1, SEGMENT)


def pooled(net: Net, texts: list[bytes]) -> np.ndarray:
    """(texts, labels): mean probabilities over the letters of each text; zeros where there is none."""
    sums, letters = np.zeros((len(texts), len(net.bias))), np.zeros(len(texts))
    for owner, rows in _segments(texts):
        used = SEGMENT - np.argmax(rows[:, ::-1] != 0, axis=1)  # of a segment of zeros: all of it
        letters += np.bincount(owner, weights=_LETTER[rows].sum(axis=1), minlength=len(texts))
        order = np.argsort(-used, kind="stable")  # short ends of texts go together
        for lo in range(0, len(order), SIDE):
            some = order[lo : lo + SIDE]
            x = np.ascontiguousarray(rows[some, : int(used[some[0]])].T).astype(np.intp)
            found = label(net, x)
            for k in range(len(net.bias)):
                sums[:, k] += np.bincount(owner[some], weights=found[k], minlength=len(texts))
    return sums / np.maximum(letters, 1)[:, None]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, units: int = UNITS, steps: int = STEPS) -> tuple[list[str], Net | None]:
    """The languages, in order, and a network trained on at most `sample` different texts of each.

    Rows with a text that holds a letter, a language, and an id whose CRC isn't
    divisible by FOLDS teach.  Of each language the texts of the smallest
    hashes do, by SNIPPETS snippets of 2 SEGMENT characters from hashed places;
    equal texts count once.
    """
    spark = docs.sparkSession
    cl.ship(spark)
    slim = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")).alias("crc"))
    known = slim.where(f"lang is not null and crc % {FOLDS} <> 0 and text rlike '\\\\p{{L}}'").withColumn("key", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return [], None
    langs = sorted(counts)
    if len(langs) == 1:
        return langs, None
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 3 * sample / n)))])
    drawn = known.where(F.pmod("key", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    places = F.array(*[F.pmod(F.xxhash64("key", F.lit(k)), F.greatest(F.lit(1), F.char_length("text") - SEGMENT)) for k in range(SNIPPETS)])
    drawn = drawn.select("lang", "key", F.transform(places, lambda at: F.substring("text", (at + 1).cast("int"), F.lit(2 * SEGMENT))).alias("snippets")).dropDuplicates(["lang", "key"])
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("r") <= sample).select("lang", "key", "snippets")

    def fit(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("lang", "key", "snippets")], strict=True), key=lambda r: r[:2])
        taught = [[s.encode() for lang, _, some in rows if lang == of for s in some if has_letter(s.encode())] or [b"?"] for of in langs]
        net = train(taught, units, steps)
        return pa.table({"weights": pa.array([a.astype(np.float32).tobytes() for a in net.arrays()], pa.binary()), "k": pa.array(range(5), pa.int32())})

    shapes = [a.shape for a in Net.fresh(len(langs), units, np.random.default_rng(0)).arrays()]
    got = sorted(drawn.groupBy().applyInArrow(fit, "weights binary, k int").collect(), key=lambda r: r["k"])
    return langs, Net(*[np.frombuffer(r["weights"], np.float32).reshape(s) for r, s in zip(got, shapes, strict=True)])


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, units: int = UNITS, steps: int = STEPS) -> DataFrame:
    """(id, held_out, lang_pred, score) per row: the language of the largest mean probability, and that.

    The id decides held_out alone, and the language column is read for training
    alone; a prediction sees the text only, all of it.  A text that is null or
    holds no letter is UNKNOWN with score 0; so is every text where nothing
    teaches (an empty table, no labels).  Where one language teaches, it is
    every text's, with score 1.  Ties go to the first language.  A null id is
    neither held out nor taught from.  Repeated rows are each labelled, and
    alike.  Other columns are left alone.
    """
    langs, net = learn(docs, id_col, text_col, lang_col, sample, units, steps)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            names = [None if i is None else str(i).encode() for i in batch.column(0).to_pylist()]
            texts = [t.as_py() for t in batch.column(1).cast(pa.large_binary())]
            known = [bool(langs) and has_letter(t) for t in texts]
            if net is None:
                best, score = np.zeros(len(texts), np.int64), np.ones(len(texts))
            else:
                mean = pooled(net, [t if k else b"" for t, k in zip(texts, known, strict=True)])
                best, score = mean.argmax(axis=1), np.minimum(1.0, mean.max(axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([i is not None and crc32(i) % FOLDS == 0 for i in names], pa.bool_()),
                    pa.array([langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)], pa.string()),
                    pa.array([float(s) if k else 0.0 for s, k in zip(score, known, strict=True)], pa.float64()),
                ],
                names=["id", "held_out", "lang_pred", "score"],
            )

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
