"""Filter interaction audit: what each order of a set of filters removes, and each filter's share over all orders.

Texts are measured once, in place: a row keeps which filters it fails as the
bits of a mask, and a digest of its text.  Everything after that is sums: rows
are counted by (part, mask) with their labels, and the orders of the filters
are visited by single swaps of neighbours, each of which changes two steps of
the order before it.  Those two are read anew from the at most 2**n cells of a
part; the others stand.  Shapley sums add up along the walk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _cluster as cl

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
#: Bytes of a code point after its first.
_FOLLOWING = bytes(range(0x80, 0xC0))
#: Words of a text are counted in pieces of so many bytes; only its different words are held together.
PIECE = 4 << 20
#: Filters beyond which the orders are too many to list.
MOST_FILTERS = 7


@dataclass(frozen=True)
class Measures:
    words: int
    distinct: int
    capitals: int
    chars: int
    marked: bool


#: A filter's name and what fails it, by the measures of one text.
RULES: dict[str, Callable[[Measures], bool]] = {
    "A": lambda m: m.words < 200,
    "B": lambda m: 100 * m.distinct < 50 * m.words,
    "C": lambda m: 100 * m.capitals > 3 * m.chars,
    "D": lambda m: m.marked,
}
#: The filter that a text fails which a row with a smaller id has too.
REPEATS = "E"


def vocabulary(text: bytes, piece: int = PIECE) -> tuple[int, int]:
    """Words and different words of a text."""
    n, at, seen = 0, 0, set()
    while at < len(text):
        end = at + piece
        found = _SPACE.search(text, end) if end < len(text) else None
        end = found.start() if found else len(text)
        words = text[at:end].split()  # bytes are split at just those six characters
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def measure(text: bytes) -> Measures:
    words, distinct = vocabulary(text)
    return Measures(words, distinct, len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _FOLLOWING)), len(text.translate(None, _MARKS)) < len(text))


def filter_masks(docs: DataFrame, rules: dict[str, Callable[[Measures], bool]] = RULES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, digest, mask) per row: bit k is set where the text fails the k-th rule.  A null text is empty, a null part the empty string."""
    cl.ship(docs.sparkSession)
    checks = list(rules.values())

    def run(batches):
        for batch in batches:
            masks, digests = [], []
            for text in batch.column(2).cast(pa.large_binary()):
                raw = text.as_py()
                m = measure(raw)
                masks.append(sum(1 << k for k, check in enumerate(checks) if check(m)))
                digests.append(blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["id", "part", "digest", "mask"])

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, part string, digest binary, mask int")


def cells(masks: DataFrame, labels: DataFrame, repeats: int | None, label_id: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and mask, where the bit `repeats` (None: no such filter) is set for texts that a row with a smaller id has.

    Equal rows are counted before they move; rows that share a text are counted
    by part and label, so a large group of copies is a few rows.
    """
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    rows = masks.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(known, rows["id"] == known["_id"], "left").select("id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    weighed = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    if repeats is None:
        return rows.groupBy("part", "mask").agg(*weighed)
    held = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    # Of each text, part and label: the rows, those without an id, and the smallest id with its rows.
    copies = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.min(held).alias("least"))
    from pyspark.sql import Window

    first = F.min("least.id").over(Window.partitionBy("digest"))  # a row for each part and label that the text has
    copies = copies.withColumn("stay", F.col("unnamed") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(F.lit(0)))
    again = F.struct((F.col("mask") + (1 << repeats)).alias("mask"), (F.col("n") - F.col("stay")).alias("n"))
    each = copies.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("stay").alias("n")), again)).alias("x")).select("part", "good", "toxic", "x.*").where("n > 0")
    return each.groupBy("part", "mask").agg(*weighed)


def swaps(n: int) -> Iterator[int]:
    """Places k whose neighbours k, k + 1 are swapped one after another to visit all orders of n things (Johnson and Trotter)."""
    if n < 2:
        return
    inner = swaps(n - 1)
    down = True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)  # the last thing passes through the others
        k = next(inner, None)
        if k is None:
            return
        yield k + down  # the others move on; behind the last thing where it stands in front
        down = not down


def walk(counts: np.ndarray, names: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step.

    counts[mask]: rows, good rows and toxic rows with that mask.
    """
    n = len(names)
    masks = np.arange(1 << n)

    def step(before: int, f: int) -> np.ndarray:
        """Removed rows, good and toxic ones, and rows kept, where the filters `before` have been applied and then f."""
        reached = masks & before == 0
        fails = masks >> f & 1 == 1
        return np.append(counts[reached & fails].sum(axis=0), counts[reached & ~fails, 0].sum())

    order, at, before = list(range(n)), [], 0
    for f in order:
        at.append(step(before, f))
        before |= 1 << f
    fails = [int(counts[masks >> f & 1 == 1, 0].sum()) for f in range(n)]
    shapley, visited = [0] * n, []

    def visit() -> None:
        for f, x in zip(order, at, strict=True):
            shapley[f] += int(x[0])
        visited.append((tuple(order), [tuple(map(int, x)) for x in at]))

    visit()
    for k in swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        before = sum(1 << f for f in order[:k])
        at[k], at[k + 1] = step(before, order[k]), step(before | 1 << order[k], order[k + 1])
        visit()
    return [
        ("".join(names[f] for f in order), k + 1, kept, removed, fails[f] - removed, int(counts[1 << f, 0]), good, toxic, shapley[f])
        for order, steps in visited
        for k, (f, (removed, good, toxic, kept)) in enumerate(zip(order, steps, strict=True))
    ]


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_filters(docs: DataFrame, labels: DataFrame, rules: dict[str, Callable[[Measures], bool]] = RULES, repeats: str | None = REPEATS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """SCHEMA: a row per part, order of the filters and step, zeros included.

    Filters are the rules, each named by one letter, and `repeats`: rows whose
    text a row with a smaller id has, wherever that one ends.  Rows without an
    id repeat nothing and are repeated by nothing; equal rows (one id, one
    text) don't repeat each other, and each counts.  A null text is empty, a
    null part the empty string, which is one part with empty ones.  Rows are
    good (toxic) where any label of their id says 1; others, and ids without
    labels, are neither.  Extra columns are left alone.  An empty table has no
    part and gives no row.
    """
    names = "".join(rules) + (repeats or "")
    if len(set(names)) != len(rules) + bool(repeats) or not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"filters need different names of one letter, {MOST_FILTERS} at most ({factorial(MOST_FILTERS)} orders)")
    found = cells(filter_masks(docs, rules, id_col, text_col, part_col), labels, len(rules) if repeats else None)

    def orders(key, table):
        counts = np.zeros((1 << len(names), 3), np.int64)
        counts[table.column("mask").to_numpy()] = np.stack([table.column(c).to_numpy() for c in ("n", "good", "toxic")], axis=1)
        rows = walk(counts, names)
        types = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(rows), pa.string()), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return found.groupBy("part").applyInArrow(orders, SCHEMA)
