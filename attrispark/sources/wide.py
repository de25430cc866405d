"""Games of more players than a mask of one number has bits for.

A coalition is an array of words of WORD bits, a term the sorted array of its
members: facts touch few of many players, so terms stay as small as the facts
make them, while a coalition may hold anyone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrispark.functions.ship import ship
from attrispark.sources.games import few, read, revenue

#: Players of one word, and of a game: results and coalitions are arrays of that size.
WORD, MOST_PLAYERS = 62, 100_000
#: Members of all terms together up to which they travel with every task.
SMALL_MEMBERS = 2_000_000
#: Cells of a task's table of coalitions by members.
CELLS = 1 << 22
#: Bits of the coalitions that meet the terms together.
BLOCK = 1 << 26


def words_for(n: int) -> int:
    return max(1, ceil(n / WORD))


def words_of(players: Column, n: int) -> Column:
    """The words of an array of players."""
    one = F.lit(1).cast("bigint")
    word = lambda j: F.aggregate(F.filter(players, lambda i: F.floor(i / WORD) == j), F.lit(0).cast("bigint"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", one, (i % WORD).cast("int"))))
    return F.transform(F.sequence(F.lit(0), F.lit(words_for(n) - 1)), word)


def words_of_first(digests: Column, size: Column, n: int) -> Column:
    """The words of the `size` players of the smallest digests (an array by player, no two alike): each word looks at its own players only."""
    one = F.lit(1).cast("bigint")

    def word(j: Column, all_of: Column, last: Column) -> Column:
        inside = F.sequence(j * WORD, F.least(F.lit(n), j * WORD + WORD) - 1)
        return F.aggregate(inside, F.lit(0).cast("bigint"), lambda m, i: F.when(F.get(all_of, i) <= last, m.bitwiseOR(F.call_function("shiftleft", one, (i - j * WORD).cast("int")))).otherwise(m))

    def words(both: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(words_for(n) - 1)), lambda j: word(j, both["d"], both["last"]))

    # Arrays of one, so that the digests and the last of them are computed once.
    ranked = F.transform(F.array(digests), lambda d: F.struct(d.alias("d"), F.get(F.sort_array(d), size - 1).alias("last")))
    return F.get(F.transform(ranked, words), F.lit(0))


def full_words(n: int) -> list[int]:
    return [(1 << min(WORD, n - WORD * j)) - 1 for j in range(words_for(n))]


def holds(words: Column, player: Column) -> Column:
    """Whether the coalition has the player."""
    return F.getbit(F.get(words, F.floor(player / WORD).cast("int")), (player % WORD).cast("int")) == 1


def contains(words: Column, members: Column) -> Column:
    """Whether the coalition has all members of the term."""
    return F.forall(members, lambda i: holds(words, i))


def bits_of(masks, n: int) -> np.ndarray:
    """(coalitions, n) of 0 and 1 from an Arrow array of words."""
    flat = np.ascontiguousarray(masks.flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False))
    bits = np.unpackbits(flat.view(np.uint8), bitorder="little").reshape(len(masks), -1, 64)[:, :, :WORD]
    return bits.reshape(len(masks), -1)[:, :n]


def contained(bits: np.ndarray, members: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the terms inside each coalition sum up to; term k has the members from starts[k] on, one at least.

    Eight coalitions share a byte of a player's row, so a term meets them together.
    """
    u = np.zeros(len(bits))
    if not len(bits):
        return u
    rows = np.ascontiguousarray(np.packbits(bits, axis=0).T)
    step = max(1, CELLS // len(bits))
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(members), step)), len(starts)))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        some = members[starts[lo] : starts[hi] if hi < len(starts) else len(members)]
        held = np.bitwise_and.reduceat(rows[some], starts[lo:hi] - starts[lo], axis=0)
        u += weights[lo:hi] @ np.unpackbits(held, axis=1, count=len(bits))
    return u


def _flat(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members, starts and weights of an Arrow table of terms; the empty term is left to who asks."""
    members, weights = rows.column("members").combine_chunks(), rows.column("w").to_numpy()
    sizes = np.diff(members.offsets.to_numpy())
    return members.flatten().to_numpy().astype(np.intp), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.intp), weights


@dataclass
class WideGame:
    """n players and terms (members, w), summed by members."""

    n: int
    terms: DataFrame
    name: str = ""
    _known: dict = field(default_factory=dict, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.terms.sparkSession

    def _summary(self) -> tuple[float, float, int]:
        """U of no player and of all players, and the members of all terms together: one job for these terms."""
        if self._known.get("of") is not self.terms:
            total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
            row = self.terms.agg(total(F.when(F.size("members") == 0, F.col("w"))).alias("a"), total(F.col("w")).alias("b"), F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("m")).first()
            self._known = {"of": self.terms, "summary": (float(row["a"]), float(row["b"]), int(row["m"]))}
        return self._known["summary"]

    def bounds(self) -> tuple[float, float]:
        """U of no player and of all players."""
        return self._summary()[:2]

    def _terms(self):
        """(members, starts, weights) where they are small enough to travel with every task, else their number; counted first."""
        count = self._summary()[2]
        if count > SMALL_MEMBERS:
            return count
        if "small" not in self._known:
            self._known["small"] = _flat(self.terms.where(F.size("members") > 0).select("members", "w").toArrow())
        return self._known["small"]

    def attach(self, samples: DataFrame) -> DataFrame:
        """samples (k, side, mask, ...) with u; k and side name a sample."""
        ship(self.spark)
        n, empty, known = self.n, self.bounds()[0], self._terms()
        names = samples.columns
        if not isinstance(known, int):
            members, starts, weights = known

            def run(batches):
                import pyarrow as pa

                for batch in batches:
                    u = contained(bits_of(batch.column(names.index("mask")), n), members, starts, weights) if len(starts) else np.zeros(batch.num_rows)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(u + empty)], names=[*names, "u"])

            return samples.mapInArrow(run, T.StructType([*samples.schema.fields, T.StructField("u", T.DoubleType())]))
        # A (block of samples, chunk of terms) pair is one piece of work of bounded size.  Terms move once for a block, and all
        # coalitions are one block until their bits exceed BLOCK.  A sample's other columns travel with the first chunk.
        chunks, blocks = ceil(known / SMALL_MEMBERS), max(1, ceil(samples.count() * n / BLOCK))
        left = samples.select("*", F.pmod(F.xxhash64("k", "side"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
        real = self.terms.where(F.size("members") > 0).select(F.pmod(F.xxhash64("members"), F.lit(chunks)).cast("int").alias("chunk"), "members", "w")
        right = real.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))
        rest = [c for c in names if c not in ("k", "side")]

        def part(some, terms):
            import pyarrow as pa

            u = np.zeros(some.num_rows)
            if some.num_rows and terms.num_rows:
                u = contained(bits_of(some.column("mask").combine_chunks(), n), *_flat(terms))
            first = some.num_rows and some.column("chunk")[0].as_py() == 0
            own = {c: some.column(c) if c in ("k", "side") or first else pa.nulls(some.num_rows, some.schema.field(c).type) for c in names}
            return pa.table(own | {"u": pa.array(u, pa.float64())})

        parts = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(part, T.StructType([*(T.StructField(f.name, f.dataType) for f in samples.schema.fields), T.StructField("u", T.DoubleType())]))
        summed = parts.groupBy("k", "side").agg(*[F.any_value(c, F.lit(True)).alias(c) for c in rest], (F.sum("u") + F.lit(empty)).alias("u"))
        return summed.select(*names, "u")


def from_facts(facts: DataFrame, group: list[str], player: str, measure: str) -> DataFrame:
    """Terms (members, w): per group the set of its players and the sum of its measure, then summed by set."""
    per_group = facts.groupBy(*group).agg(F.array_sort(F.collect_set(F.col(player).cast("int"))).alias("members"), F.sum(measure).alias("w"))
    return per_group.groupBy("members").agg(F.sum("w").alias("w"))


def supplier_revenue(spark: SparkSession, sf_dir: str) -> WideGame:
    """All suppliers, numbered by key; a term per order."""
    numbered = few(read(spark, sf_dir, "supplier").select("s_suppkey").withColumn("player", (F.row_number().over(Window.orderBy("s_suppkey")) - 1).cast("int")), MOST_PLAYERS)
    facts = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", revenue().alias("v")).join(numbered, F.col("l_suppkey") == F.col("s_suppkey"))
    return WideGame(numbered.count(), from_facts(facts, ["l_orderkey"], "player", "v"), "supplier")
