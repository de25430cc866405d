"""Cooperative games built from tables.

The usual game is a table of unanimity terms (mask, w): each fact group (an
order, a user's day) has the mask of the entities it touches and its measure,
and a coalition is worth the terms it contains whole.  Terms of equal masks
are summed as soon as they are known, so what follows depends on the number of
different masks, not of facts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrispark.functions import draws
from attrispark.functions.ship import ship

#: Up to so many players all coalitions are tabulated; beyond, only those asked for.
TABLE_PLAYERS = 16
#: Up to so many players that is done inside one row: each player's step names the array before it twice.
ROW_PLAYERS = 5
#: Terms up to this number are sent to every task; more are met chunk by chunk.
SMALL_TERMS = 200_000


def bit(player: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), player.cast("int"))


def contained_worth(masks: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the terms inside each mask sum up to, by blocks of masks and terms."""
    u = np.zeros(len(masks))
    for lo in range(0, len(masks), 1024):
        for t in range(0, len(terms), 1024):
            some = terms[t : t + 1024]
            u[lo : lo + 1024] += ((masks[lo : lo + 1024, None] & some) == some) @ weights[t : t + 1024]
    return u


def _with_player(i: int) -> Column:
    """The array v of worths by mask, each mask that has player i adding the one without."""
    return F.transform("v", lambda x, m: F.when(F.getbit(m, F.lit(i)) == 1, x + F.get(F.col("v"), m - (1 << i))).otherwise(x))


@dataclass
class TermsGame:
    """n players and terms (mask, w), summed by mask."""

    n: int
    terms: DataFrame
    name: str = ""
    _known: list = field(default_factory=list, repr=False)

    @property
    def full(self) -> int:
        return (1 << self.n) - 1

    @property
    def spark(self) -> SparkSession:
        return self.terms.sparkSession

    def table(self) -> DataFrame:
        """(mask, u) of all coalitions, by a superset-sum transform over players: n steps inside one array, or over arrays where there are more."""
        if self.n > TABLE_PLAYERS:
            raise ValueError(f"{self.n} players have too many coalitions to tabulate")
        if self.n > ROW_PLAYERS:
            from attrispark.operators import transform

            return transform.table(self)
        size = 1 << self.n
        start = self.terms.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("mask", "w"))).alias("t"))
        values = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint")), lambda m: F.coalesce(F.try_element_at(F.col("t"), m), F.lit(0.0)))
        out = start.select(values.alias("v"))
        for i in range(self.n):
            out = out.select(_with_player(i).alias("v"))
        return out.select(F.posexplode("v").alias("mask", "u")).select(F.col("mask").cast("bigint"), "u")

    def _arrays(self):
        """The terms as arrays where they are few enough to travel with every task, else None; counted once."""
        if not self._known:
            rows = self.terms.select("mask", "w").limit(SMALL_TERMS + 1).toPandas()
            self._known = [(rows["mask"].to_numpy(np.int64), rows["w"].to_numpy(np.float64)) if len(rows) <= SMALL_TERMS else None]
        return self._known[0]

    def attach(self, samples: DataFrame, column: str = "mask") -> DataFrame | None:
        """samples with u, evaluated in place, where coalitions are too many to repeat often and terms few; else None.

        Blocks of masks meet blocks of terms in arrays: no shuffle and no pair of them becomes a row.
        """
        arrays = self._arrays() if self.n > 12 else None
        if arrays is None:
            return None
        ship(self.spark)
        masks_of, weights = arrays
        names = samples.columns
        at = names.index(column)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                u = contained_worth(batch.column(at).to_numpy(), masks_of, weights)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(u)], names=[*names, "u"])

        return samples.mapInArrow(run, T.StructType([*samples.schema.fields, T.StructField("u", T.DoubleType())]))

    def evaluate(self, masks: DataFrame) -> DataFrame:
        """(mask, u) of the distinct masks asked for; each is evaluated once however often it was sampled."""
        asked = masks.select("mask").distinct()
        if self.n <= 12:
            return asked.join(F.broadcast(self.table()), "mask")  # at most 4096 rows
        if (found := self.attach(asked)) is not None:
            return found
        from attrispark.operators import transform

        if self.n <= transform.MOST_PLAYERS:
            return transform.evaluate(self, asked)
        chunks = ceil(self.terms.count() / SMALL_TERMS)
        ship(self.spark)
        blocks = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        # A (block of masks, chunk of terms) pair is one piece of work of bounded size, so no chunk is a hot key.
        block = F.pmod(F.xxhash64("mask", F.lit("block")), F.lit(blocks)).cast("int")
        left = asked.withColumn("block", block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        right = self.terms.select(F.pmod(F.xxhash64("mask"), F.lit(chunks)).cast("int").alias("chunk"), "mask", "w").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def contained(masks, terms):
            import pyarrow as pa

            if not masks.num_rows:
                return pa.table({"mask": pa.array([], pa.int64()), "u": pa.array([], pa.float64())})
            return pa.table({"mask": masks.column("mask"), "u": pa.array(contained_worth(masks.column("mask").to_numpy(), terms.column("mask").to_numpy(), terms.column("w").to_numpy()) if terms.num_rows else np.zeros(masks.num_rows))})

        parts = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(contained, "mask bigint, u double")
        return parts.groupBy("mask").agg(F.sum("u").alias("u"))

    def bounds(self) -> tuple[float, float]:
        """U of no player and of all players."""
        row = self.terms.agg(F.coalesce(F.sum(F.when(F.col("mask") == 0, F.col("w"))), F.lit(0.0)).alias("a"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("b")).first()
        return float(row["a"]), float(row["b"])


@dataclass
class TableGame:
    """A game given by all its values (mask, u)."""

    n: int
    values: DataFrame
    name: str = ""

    @property
    def full(self) -> int:
        return (1 << self.n) - 1

    @property
    def spark(self) -> SparkSession:
        return self.values.sparkSession

    def table(self) -> DataFrame:
        return self.values.select("mask", "u")

    def evaluate(self, masks: DataFrame) -> DataFrame:
        return masks.select("mask").distinct().join(self.table(), "mask")

    def bounds(self) -> tuple[float, float]:
        rows = {r["mask"]: r["u"] for r in self.values.where(F.col("mask").isin(0, self.full)).collect()}
        return float(rows[0]), float(rows[self.full])


@dataclass
class CallableGame:
    """A black-box utility of a mask, run in Arrow batches over distinct masks."""

    n: int
    session: SparkSession
    utility: Callable[[list[int]], list[float]]
    name: str = ""

    @property
    def full(self) -> int:
        return (1 << self.n) - 1

    @property
    def spark(self) -> SparkSession:
        return self.session

    def table(self) -> DataFrame:
        return self.evaluate(self.session.range(1 << self.n).select(F.col("id").alias("mask")))

    def evaluate(self, masks: DataFrame) -> DataFrame:
        utility = self.utility

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                found = utility(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["mask", "u"])

        return masks.select(F.col("mask").cast("bigint")).distinct().mapInArrow(run, "mask bigint, u double")

    def bounds(self) -> tuple[float, float]:
        a, b = self.utility([0, self.full])
        return float(a), float(b)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_facts(facts: DataFrame, group: list[str], player: str, measure: str) -> DataFrame:
    """Terms (mask, w): per group the mask of its players and the sum of its measure, then summed by mask."""
    per_group = facts.groupBy(*group).agg(F.bit_or(bit(F.col(player))).alias("mask"), F.sum(measure).alias("w"))
    return per_group.groupBy("mask").agg(F.sum("w").alias("w"))


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


#: Players that a mask has bits for.
MASK_PLAYERS = 62


def few(players: DataFrame, most: int = MASK_PLAYERS) -> DataFrame:
    """The same rows, one per player, which stop the query where they are more than a mask has bits for: none is left out."""
    counted = players.withColumn("_players", F.count("*").over(Window.partitionBy()))  # a row per player
    checked = F.when(F.col("_players") > most, F.raise_error(F.concat(F.lit(f"at most {most} players fit a mask; there are "), F.col("_players").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return counted.where(checked).drop("_players")


def _numbered(values: DataFrame, name: str, most: int) -> DataFrame:
    """Dense player numbers of the distinct values of a small dimension, in their order; more than `most` are refused."""
    return few(values.select(name).distinct().withColumn("player", F.row_number().over(Window.orderBy(name)) - 1), most)


def region_revenue(spark: SparkSession, sf_dir: str) -> TermsGame:
    """5 supplier regions; a term per order."""
    supplier = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("player"))
    facts = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", revenue().alias("v")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return TermsGame(5, from_facts(facts, ["l_orderkey"], "player", "v"), "region")


def nation_revenue(spark: SparkSession, sf_dir: str) -> TermsGame:
    """25 supplier nations; a term per order."""
    facts = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", revenue().alias("v")).join(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("player")), F.col("l_suppkey") == F.col("s_suppkey"))
    return TermsGame(25, from_facts(facts, ["l_orderkey"], "player", "v"), "nation")


def brand_revenue(spark: SparkSession, sf_dir: str) -> TermsGame:
    """25 part brands; a term per order."""
    part = read(spark, sf_dir, "part")
    named = part.select("p_partkey", "p_brand").join(F.broadcast(_numbered(part, "p_brand", 25)), "p_brand")
    facts = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", revenue().alias("v")).join(named, F.col("l_partkey") == F.col("p_partkey"))
    return TermsGame(25, from_facts(facts, ["l_orderkey"], "player", "v"), "brand")


def segment_part_year(spark: SparkSession, sf_dir: str) -> TermsGame:
    """5 market segments; a term per part and ship year."""
    customer = read(spark, sf_dir, "customer")
    named = customer.select("c_custkey", "c_mktsegment").join(F.broadcast(_numbered(customer, "c_mktsegment", 5)), "c_mktsegment")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(named, F.col("o_custkey") == F.col("c_custkey"))
    facts = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.year("l_shipdate").alias("y"), revenue().alias("v")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return TermsGame(5, from_facts(facts, ["l_partkey", "y"], "player", "v"), "segment")


def supplier_shares(spark: SparkSession, sf_dir: str) -> TermsGame:
    """10 players that share the suppliers by turns of their key; a term per order."""
    facts = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).alias("player"), revenue().alias("v"))
    return TermsGame(10, from_facts(facts, ["l_orderkey"], "player", "v"), "share")


def event_user_day(spark: SparkSession, sf_dir: str) -> TermsGame:
    """5 event types; a term per user and day."""
    events = read(spark, sf_dir, "events")
    named = events.select("user_id", F.to_date("ts").alias("day"), "event_type", "value").join(F.broadcast(_numbered(events, "event_type", 5)), "event_type")
    return TermsGame(5, from_facts(named, ["user_id", "day"], "player", "value"), "event")


GAMES = {"region": region_revenue, "nation": nation_revenue, "brand": brand_revenue, "segment": segment_part_year, "event": event_user_day, "share": supplier_shares}


def additive(weights: DataFrame, n: int, transform: Callable[[Column], Column] | None = None, lam: float = 0.0, sigma: float = 1.0, seed: int = 0, noise: Callable[[Column], Column] | None = None) -> TableGame:
    """U(S) = f((1 - lam) sum of weights + lam sigma Z(S)) over weights (player, w).

    Z hashes the coalition: per-player 64-bit keys are XORed and read as a
    uniform number; `noise` maps it on (by default the inverse normal).
    """
    if n > TABLE_PLAYERS:
        raise ValueError(f"{n} players have too many coalitions to tabulate; lazy.AdditiveGame evaluates those asked for")
    spark = weights.sparkSession
    masks = spark.range(1 << n).select(F.col("id").alias("mask"))
    members = masks.join(F.broadcast(few(weights)), F.expr("getbit(mask, player) = 1"), "left")
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"zobrist:{seed}:"), F.col("player").cast("string")).cast("binary")), 1, 13), 16, 10).cast("bigint")
    summed = members.groupBy("mask").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("a"), F.coalesce(F.bit_xor(key), F.lit(0)).alias("h"))
    z = (F.col("h") + 0.5) / F.lit(float(1 << draws.BITS))
    value = F.col("a") if not lam else (1 - lam) * F.col("a") + lam * sigma * (noise or inverse_normal)(z)
    return TableGame(n, summed.select("mask", (transform(value) if transform else value).alias("u")), "additive")


def inverse_normal(z: Column) -> Column:
    """Quantile of the standard normal law, by Newton steps on an erf series: no built-in has it, and it stays in the JVM."""

    def cdf(x: Column) -> Column:
        # Abramowitz-Stegun 7.1.26 is too coarse for Newton; Marsaglia's series converges for all x met here.
        terms = F.aggregate(
            F.sequence(F.lit(1), F.lit(60)),
            F.struct(x.cast("double").alias("t"), x.cast("double").alias("s")),
            lambda acc, k: F.struct((acc["t"] * x * x / (2 * k + 1)).alias("t"), (acc["s"] + acc["t"] * x * x / (2 * k + 1)).alias("s")),
        )["s"]
        return 0.5 + terms * F.exp(-x * x / 2) / F.lit(2.5066282746310002)

    clipped = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), z))
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0.0), lambda x, _: x - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (cdf(x) - clipped) * F.lit(2.5066282746310002) * F.exp(x * x / 2))))


def _meet(points: DataFrame, queries: DataFrame, block: int, keep: int | None = None) -> DataFrame:
    """(query, player, id, dist, hit): distances of queries to points (player, id, embedding, label), of each player's only the `keep` nearest of a block.

    Points and queries meet block by block: blocks of `block` vectors each are
    built once, and a pair of blocks is one piece of work, so neither side is
    broadcast whole and none is left out.
    """
    ship(points.sparkSession)

    def blocks(side: DataFrame, ident: str, *more: str) -> tuple[DataFrame, int]:
        n = max(1, -(-side.count() // block))
        return side.select(F.pmod(F.xxhash64(ident), F.lit(n)).cast("int").alias(f"_{ident}"), F.col(ident).cast("bigint").alias(ident), *[F.col(c).cast("bigint").alias(c) for c in more], F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label")), n

    left, n_left = blocks(points, "id", "player")
    right, n_right = blocks(queries, "query")
    left = left.withColumn("_query", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = right.withColumn("_id", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))

    def distances(a, b):
        import pyarrow as pa

        names = ["query", "player", "id", "dist", "hit"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())], names=names)
        x, y = (np.array(t.column("embedding").to_pylist(), np.float64) for t in (a, b))
        d = np.stack([((x - q) ** 2).cumsum(axis=1)[:, -1] for q in y])  # in the order of components, as a row at a time would
        la, lb = (np.array(t.column("label").to_pylist()) for t in (a, b))
        owner, ident = a.column("player").to_numpy(), a.column("id").to_numpy()
        if keep is None:
            q, p = (i.reshape(-1) for i in np.indices(d.shape))
        else:
            picked = []
            for row in d:
                order = np.lexsort((ident, row, owner))
                first = np.flatnonzero(np.concatenate([[True], owner[order][1:] != owner[order][:-1]]))
                place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                picked.append(order[place < keep])
            q, p = np.repeat(np.arange(len(d)), [len(x) for x in picked]), np.concatenate(picked)
        return pa.table([pa.array(b.column("query").to_numpy()[q]), pa.array(owner[p]), pa.array(ident[p]), pa.array(d[q, p]), pa.array((lb[q] == la[p]).astype(np.int32))], names=names)

    return left.groupBy("_id", "_query").cogroup(right.groupBy("_id", "_query")).applyInArrow(distances, "query bigint, player bigint, id bigint, dist double, hit int")


#: Ranges of distance that a query's points are ordered in, where they are too many for a task.
RANGES = 32
#: Numbers of all points together up to which a task holds them (512 MB in single precision).
SMALL_POINTS = 1 << 27
#: Points that distances are taken to at a time, from so many queries.
TILE, ASKED = 4096, 8


def _distances(queries: np.ndarray, tiles: list[np.ndarray]) -> np.ndarray:
    """Squared distances of queries to the points of all tiles (components, points), added in the order of components, as a row at a time would."""
    out = np.zeros((len(queries), sum(t.shape[1] for t in tiles)))
    at = 0
    for tile in tiles:
        part = out[:, at : at + tile.shape[1]]
        for j, column in enumerate(tile):
            apart = column.astype(np.float64) - queries[:, j : j + 1]
            apart *= apart
            part += apart
        at += tile.shape[1]
    return out


def _by_query(points: DataFrame, queries: DataFrame, each: Callable, kind: str) -> DataFrame | None:
    """What each(players, ordered) yields for every share of the queries, or None where a task can't hold the points.

    ordered gives (query, order, hit) per query: the places of all players by
    distance, ties to the smaller player, and which labels match in that order.
    A share meets all points in one task, a query at a time, so pairs of a
    query and a point are never moved.  The shares follow the cores, not the
    queries: what moves is the points, once a share.
    """
    spark = points.sparkSession
    ship(spark)
    size = points.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first().asDict()
    if size["n"] * max(1, size["d"]) > SMALL_POINTS:
        return None
    shares = max(1, min(queries.count(), 2 * spark.sparkContext.defaultParallelism))
    single = dict(points.dtypes)["embedding"] == dict(queries.dtypes)["embedding"] == "array<float>"
    rows = lambda side, ident, share: side.select(share.alias("share"), F.lit(ident == "query").alias("asks"), F.col(ident).cast("bigint").alias("id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    met = rows(points, "player", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).unionByName(rows(queries, "query", F.pmod(F.xxhash64("query"), F.lit(shares)).cast("int")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tiles, found = {}, [], {True: [], False: []}
        asked = []
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            if size["n"] and (np.diff(batch.column("embedding").offsets.to_numpy()) != size["d"]).any():
                raise ValueError(f"embeddings have different lengths; the longest has {size['d']}")
            vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            label = np.array([codes.setdefault(x, len(codes)) for x in batch.column("label").to_pylist()], np.int64)
            ident = batch.column("id").to_numpy()
            for side in (True, False):
                found[side].append((ident[asks == side], label[asks == side]))
            asked.append(vectors[asks].astype(np.float64))
            own = vectors[~asks]
            tiles += [np.ascontiguousarray(own[lo : lo + TILE].T) for lo in range(0, len(own), TILE)]
        (query, sought), (player, label) = ([np.concatenate(x) for x in zip(*found[side], strict=True)] for side in (True, False))
        if not len(query) or not len(player):
            return
        by_player = np.argsort(player, kind="stable")
        player, label, asked = player[by_player], label[by_player], np.concatenate([x for x in asked if len(x)])

        def ordered():
            for lo in range(0, len(query), ASKED):
                for i, row in enumerate(_distances(asked[lo : lo + ASKED], tiles), start=lo):
                    d = row[by_player]
                    order = np.argsort(d)
                    if not (np.diff(d[order]) > 0).all():
                        order = np.argsort(d, kind="stable")
                    yield query[i], order, (label[order] == sought[i]).astype(np.int32)

        yield from each(player, ordered())

    return met.groupBy("share").applyInArrow(run, kind)


def knn_ranks(points: DataFrame, queries: DataFrame, block: int = 256) -> DataFrame:
    """(query, player, r, hit): every player's rank by distance for each query, ties to the smaller player.

    points (player, embedding, label), queries (query, embedding, label).
    Points that a task can hold meet every query in one; else a query's points
    are dealt into RANGES ranges of distance, each ordered by itself, and the
    ranks before a range are those ranges' counts.
    """

    def ranks(player, ordered):
        for query, order, hit in ordered:
            yield pa.RecordBatch.from_pydict({"query": np.full(len(order), query), "player": player[order].astype(np.int32), "r": np.arange(1, len(order) + 1, dtype=np.int32), "hit": hit})

    whole = _by_query(points, queries, ranks, "query bigint, player int, r int, hit int")
    if whole is not None:
        return whole
    return _ranked(_meet(points.withColumn("id", F.col("player")), queries, block)).select("query", F.col("player").cast("int").alias("player"), (F.col("before") + F.col("place")).cast("int").alias("r"), "hit")


def _ranked(pairs: DataFrame) -> DataFrame:
    """pairs with the range of their distance, their place in it, and the points of the ranges before it."""
    steps = [i / RANGES for i in range(1, RANGES)]
    cuts = pairs.groupBy("query").agg(F.percentile_approx("dist", steps, 1000).alias("cuts"))
    ranged = pairs.join(cuts, "query").withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("dist")))).drop("cuts")
    held = ranged.groupBy("query", "range").agg(F.count("*").alias("points"))
    before = held.select("query", "range", (F.sum("points").over(Window.partitionBy("query").orderBy("range")) - F.col("points")).alias("before"))  # a row per range
    place = F.row_number().over(Window.partitionBy("query", "range").orderBy("dist", "player"))
    return ranged.withColumn("place", place).join(before, ["query", "range"])


def knn_nearest(points: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(query, player, r, hit): of each player's points (player, id, embedding, label) the k nearest to each query, in the order of the query's distances.

    Only those can count among the k nearest of a coalition.  A pair of blocks
    keeps k a player, and those are merged; nothing orders all points.
    """
    some = _meet(points, queries, block, k)
    near = some.withColumn("_n", F.row_number().over(Window.partitionBy("query", "player").orderBy("dist", "id"))).where(F.col("_n") <= k)
    return near.select("query", "player", F.row_number().over(Window.partitionBy("query").orderBy("dist", "id")).alias("r"), "hit")


def knn_game(ranks: DataFrame, n: int, k: int) -> TableGame:
    """U(S): the mean over queries of the matching labels among the k nearest points of S, over k; for n players that can be enumerated.

    A player may own many points: of each only the k nearest to a query can
    count, so a query's ranks (all, or those of knn_nearest) are an array of at
    most n k entries.  Its worths of all coalitions are built inside the row
    and summed over queries before anything moves.
    """
    if n > TABLE_PLAYERS:
        raise ValueError(f"{n} players have too many coalitions to tabulate")
    ship(ranks.sparkSession)
    nearest = F.row_number().over(Window.partitionBy("query", "player").orderBy("r"))
    per_query = ranks.withColumn("_n", nearest).where(F.col("_n") <= k).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "player", "hit"))), lambda x: x["player"] * 2 + x["hit"]).alias("order"))

    def worths(batches):
        import pyarrow as pa

        masks, total, queries = np.arange(1 << n), np.zeros(1 << n, np.int64), 0
        for batch in batches:
            for order in batch.column(0).to_pylist():
                taken = np.zeros(1 << n, np.int64)
                for x in order:
                    inside = ((masks >> (x >> 1)) & 1) & (taken < k)
                    taken += inside
                    total += inside * (x & 1)
                queries += 1
        yield pa.RecordBatch.from_arrays([pa.array(masks), pa.array(total), pa.array(np.full(1 << n, queries))], names=["mask", "hits", "queries"])

    sums = per_query.select("order").mapInArrow(worths, "mask bigint, hits bigint, queries bigint").groupBy("mask").agg(F.sum("hits").alias("h"), F.sum("queries").alias("q"))
    return TableGame(n, sums.select("mask", (F.col("h") / (k * F.col("q"))).cast("double").alias("u")), "knn")


def knn_shapley(points: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(player, value): the exact recursion over a query's points from the farthest, averaged over queries.

    points (player, embedding, label), each a player.  A task that holds the
    points adds up its queries' values, and a row per player is what moves.
    Where the points are too many for that, running sums have two levels:
    inside a range of distance, and over the sums of the farther ranges.
    """

    def values(player, ordered):
        n, total, asked = len(player), np.zeros(len(player)), 0
        r = np.arange(1, n)
        for _, order, hit in ordered:
            step = np.append((hit[:-1] - hit[1:]) / float(k) * np.minimum(k, r) / r, hit[-1] / float(max(n, k)))
            total[order] += np.cumsum(step[::-1])[::-1]
            asked += 1
        yield pa.RecordBatch.from_pydict({"player": player, "v": total, "queries": np.full(n, asked)})

    whole = _by_query(points, queries, values, "player bigint, v double, queries bigint")
    if whole is not None:
        return whole.groupBy("player").agg((F.sum("v") / F.sum("queries")).alias("value"))
    ranked = _ranked(_meet(points.withColumn("id", F.col("player")), queries, block)).withColumn("r", F.col("before") + F.col("place"))
    in_range = Window.partitionBy("query", "range")
    farther = Window.partitionBy("query").orderBy(F.desc("range"))
    # Of each range: its first hit, which the point before it needs, and its size.
    edge = ranked.groupBy("query", "range").agg(F.min_by("hit", "place").alias("first"), F.count("*").alias("size"))
    edge = edge.select("query", "range", F.lag("first").over(farther).alias("next"), F.sum("size").over(Window.partitionBy("query")).alias("last"))
    joined = ranked.join(edge, ["query", "range"]).withColumn("after", F.coalesce(F.lead("hit").over(in_range.orderBy("place")), F.col("next")))
    step = F.when(F.col("r") == F.col("last"), F.col("hit") / F.greatest(F.col("last"), F.lit(k)).cast("double")).otherwise((F.col("hit") - F.col("after")) / F.lit(float(k)) * F.least(F.lit(k), F.col("r")) / F.col("r"))
    stepped = joined.select("query", "range", "player", "place", step.alias("step"))
    sums = stepped.groupBy("query", "range").agg(F.sum("step").alias("s"))
    beyond = sums.select("query", "range", (F.sum("s").over(farther) - F.col("s")).alias("beyond"))  # a row per range
    back = in_range.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    values = stepped.join(beyond, ["query", "range"]).withColumn("v", F.col("beyond") + F.sum("step").over(back))
    return values.groupBy("player").agg(F.avg("v").alias("value"))


def ridge(rows: DataFrame, n: int, beta: tuple[float, float], penalty: float, averaged: bool = False) -> TableGame:
    """Squared coefficient error of a two-feature ridge fit on the rows (player, x1, x2, y) of a coalition, by Cramer's rule.

    A player holds any number of rows; they are summed per player first, so
    all rows take part and coalitions meet one row per player.  averaged: the
    penalty grows with the coalition's rows, as for the mean loss.
    """
    if penalty <= 0:
        raise ValueError("penalty must be positive")
    if n > TABLE_PLAYERS:
        raise ValueError(f"{n} players have too many coalitions to tabulate; lazy.RidgeGame evaluates those asked for")
    masks = rows.sparkSession.range(1 << n).select(F.col("id").alias("mask"))
    products = {"a": "x1 * x1", "b": "x1 * x2", "c": "x2 * x2", "p": "x1 * y", "q": "x2 * y"}
    held = rows.groupBy("player").agg(*[F.sum(F.expr(e)).alias(c) for c, e in products.items()], F.count("*").alias("m"))
    joined = masks.join(F.broadcast(few(held)), F.expr("getbit(mask, player) = 1"), "left")
    sums = joined.groupBy("mask").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in products], F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
    weight = F.lit(penalty) * (F.greatest(F.lit(1), "m") if averaged else F.lit(1))
    a, c = F.col("a") + weight, F.col("c") + weight
    det = a * c - F.col("b") * F.col("b")
    b1, b2 = (F.col("p") * c - F.col("q") * F.col("b")) / det, (F.col("q") * a - F.col("p") * F.col("b")) / det
    return TableGame(n, sums.select("mask", ((b1 - beta[0]) * (b1 - beta[0]) + (b2 - beta[1]) * (b2 - beta[1])).alias("u")), "ridge")


def random_terms(spark: SparkSession, n: int, count: int, seed: int, kind: str = "plain", alpha: float = 0.5, sigma2: float | None = None, distinct: bool = False) -> TermsGame:
    """Sums of random unanimity terms.

    plain: sizes uniform on 1..n-1, weights uniform on (-n, n).  paper: the same
    sets, weight the mean of member number mod 4, all over count.  structured:
    every single player and pair with variance alpha^2 sigma2 / terms, and
    `count` larger sets of sizes 3..n-1 with (1 - alpha^2) sigma2 / count;
    sigma2 is by default the number of terms; distinct redraws repeated sets.
    """
    k = F.col("id")
    if kind in ("plain", "paper"):
        size = draws.draw_size(draws.uniform(k, "size", seed), {s: 1.0 for s in range(1, n)})
        base = spark.range(count).select("id", draws.bits(F.slice(draws.ranked_players(k, n, seed), F.lit(1), size)).alias("mask"))
        if kind == "plain":
            weight = (2 * draws.uniform(k, "w", seed) - 1) * n
        else:
            members = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(F.col("mask"), i) == 1)
            weight = F.aggregate(members, F.lit(0), lambda s, i: s + i % 4).cast("double") / F.size(members) / count
        return TermsGame(n, base.select("mask", weight.alias("w")).groupBy("mask").agg(F.sum("w").alias("w")), kind)
    if kind != "structured":
        raise NotImplementedError(f"unknown kind {kind!r}")
    if n < 4 or not 0 <= alpha <= 1 or count < 1:
        raise ValueError("a structured game has 4 players or more, alpha in [0, 1] and a larger set")
    low = n + n * (n - 1) // 2
    total = sigma2 if sigma2 is not None else float(low + count)
    normal = inverse_normal(draws.uniform(k, "w", seed))
    pairs = [1 << i for i in range(n)] + [(1 << i) | (1 << j) for i in range(n) for j in range(i + 1, n)]
    singles = spark.range(low).select("id", F.element_at(F.array(*[F.lit(m) for m in pairs]), (k + 1).cast("int")).cast("bigint").alias("mask"), (normal * (alpha * alpha * total / low) ** 0.5).alias("w"))
    size = draws.draw_size(draws.uniform(k, "size", seed), {s: 1.0 for s in range(3, n)})
    weight = normal * ((1 - alpha * alpha) * total / count) ** 0.5
    draw = lambda lo, hi: spark.range(lo, hi).select("id", draws.bits(F.slice(draws.ranked_players(k, n, seed), F.lit(1), size)).alias("mask"), weight.alias("w"))
    drawn = draw(low, low + count)
    if distinct:
        there = (1 << n) - 1 - low - 1  # sets of sizes 3..n-1
        if count > there:
            raise ValueError(f"{n} players have {there} sets of 3 to {n - 1} members, not {count}")
        tries = count
        while True:  # repeats are drawn again until enough different sets are met
            first = draw(low, low + tries).groupBy("mask").agg(F.min_by("w", "id").alias("w"), F.min("id").alias("id"))
            if first.count() >= count:
                break
            tries *= 2
        drawn = first.orderBy("id").limit(count).select("id", "mask", "w")  # the first `count` that were met
    terms = singles.unionByName(drawn)
    return TermsGame(n, terms.groupBy("mask").agg(F.sum("w").alias("w")), "structured")
