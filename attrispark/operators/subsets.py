"""Distinct coalitions: unranking, and sampling without replacement by size."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrispark.functions import draws


def unrank(rank: Column, n: int, size: int | Column) -> Column:
    """The mask of the rank-th set of `size` players out of n in lexicographic order, by arithmetic inside the row."""
    table = F.array(*[F.lit(comb(a, b)).cast("bigint") for a in range(n + 1) for b in range(n + 1)])

    def step(acc: Column, i: Column) -> Column:
        # sets that hold player i next: choose the rest among the players after i
        width = F.element_at(table, ((n - 1 - i) * (n + 1) + F.greatest(acc["left"] - 1, F.lit(0)) + 1).cast("int"))
        take = (acc["left"] > 0) & (acc["rank"] < width)
        return F.struct(
            F.when(take | (acc["left"] == 0), acc["rank"]).otherwise(acc["rank"] - width).cast("bigint").alias("rank"),
            F.when(take, acc["left"] - 1).otherwise(acc["left"]).cast("int").alias("left"),
            F.when(take, acc["mask"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))).otherwise(acc["mask"]).cast("bigint").alias("mask"),
        )

    start = F.struct(rank.cast("bigint").alias("rank"), (size if isinstance(size, Column) else F.lit(size)).cast("int").alias("left"), F.lit(0).cast("bigint").alias("mask"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)["mask"]


def inclusion(law: dict[int, float], n: int, count: int) -> dict[int, float]:
    """Chance per coalition of each size when min(1, c q) over all coalitions adds up to count; c by bisection."""
    total = sum(law.values())
    q = {s: v / total / comb(n, s) for s, v in law.items() if v > 0}
    everything = sum(comb(n, s) for s in q)
    if count >= everything:
        return dict.fromkeys(q, 1.0)
    lo, hi = 0.0, 1 / min(q.values())
    for _ in range(200):
        c = (lo + hi) / 2
        lo, hi = (c, hi) if sum(min(1.0, c * v) * comb(n, s) for s, v in q.items()) < count else (lo, c)
    return {s: min(1.0, hi * v) for s, v in q.items()}


#: A size whose sets are at most so many times those wanted is enumerated by rank; of others ranks are drawn until enough differ.
ENUMERATED = 4


def distinct_ranks(spark, want: dict[int, tuple[int, int]], seed: int) -> DataFrame:
    """(s, rank): for each s: (total, count) of want, `count` different numbers below `total`, every set of them as likely as any other."""
    if any(m > total for total, m in want.values()):
        raise ValueError("more different numbers are wanted than there are")
    tries = {s: total if total <= ENUMERATED * m else m + m // 8 + 16 for s, (total, m) in want.items()}
    bits = F.conv(F.substring("digest", 1, 15), 16, 10).cast("bigint")  # 60 bits, so that no rank is likelier by more than total / 2**60
    while True:
        kinds = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(total).cast("bigint").alias("total"), F.lit(m).cast("bigint").alias("m"), F.lit(tries[s]).cast("bigint").alias("tries"), F.lit(total <= ENUMERATED * m).alias("all")) for s, (total, m) in want.items()])
        drawn = spark.range(max(tries.values())).select("id", F.explode(kinds).alias("x")).select("id", "x.*").where("id < tries")
        drawn = drawn.withColumn("digest", draws.digest(F.col("id"), F.concat(F.lit("pick"), F.col("s").cast("string")), seed)).withColumn("rank", F.when(F.col("all"), F.col("id")).otherwise(F.pmod(bits, F.col("total"))))
        met = drawn.groupBy("s", "rank").agg(F.min("id").alias("id"), F.first("m").alias("m"), F.min(F.when(F.col("all"), F.col("digest"))).alias("digest"))
        found = {r["s"]: r["count"] for r in met.groupBy("s").count().collect()}
        short = [s for s, (_, m) in want.items() if found.get(s, 0) < m]
        if not short:
            break
        tries |= {s: 2 * tries[s] for s in short}
    order = F.row_number().over(Window.partitionBy("s").orderBy("digest", "id"))  # by digest where all are there, else the first that differ
    return met.withColumn("_o", order).where(F.col("_o") <= F.col("m")).select("s", "rank")


def taken(law: dict[int, float], n: int, count: int) -> dict[int, int]:
    """Coalitions of each size that a draw of `count` without replacement takes."""
    return {s: min(comb(n, s), round(p * comb(n, s))) for s, p in inclusion(law, n, count).items()}


def without_replacement(spark, law: dict[int, float], n: int, count: int, seed: int, paired: bool = False) -> DataFrame:
    """(mask, s, chance): distinct coalitions, of each size the expected number rounded; chance is what corrections divide by.

    Sets are named by their rank among those of their size, so nothing of size
    2^n is built.  paired: of sizes below n / 2 each set comes with its
    complement; of size n / 2 the sets that hold the last player do.
    """
    take = taken(law, n, count)
    want, last, times = {}, {}, {}
    for s, m in sorted(take.items()):
        middle = paired and 2 * s == n
        m = m // 2 if middle else m
        if m and not (paired and 2 * s > n):
            want[s] = (comb(n - 1, s - 1) if middle else comb(n, s), m)
            last[s], times[s] = middle, (2 * m if middle else m) / comb(n, s)
    if not want:
        return spark.createDataFrame([], "mask bigint, s int, chance double")
    ranks = distinct_ranks(spark, want, seed)
    out = ranks.select("s", unrank(F.col("rank"), n, F.col("s")).alias("mask"))
    if any(last.values()):
        half = n // 2
        with_last = unrank(F.col("rank"), n - 1, half - 1).bitwiseOR(F.lit(1 << (n - 1)).cast("bigint"))
        out = out.where(F.col("s") != half).unionByName(ranks.where(F.col("s") == half).select("s", with_last.alias("mask")))
    chance = F.element_at(F.create_map(*[F.lit(x) for s, c in times.items() for x in (s, c)]), F.col("s"))
    out = out.select("mask", chance.alias("chance"))
    if paired:
        out = out.select("chance", F.explode(F.array("mask", F.lit((1 << n) - 1).bitwiseXOR(F.col("mask")).cast("bigint"))).alias("mask"))
    return out.select("mask", F.bit_count("mask").cast("int").alias("s"), "chance")
