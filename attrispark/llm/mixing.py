"""Mixing sources to target weights by entropy balancing.

Rates w_i of documents minimise the token-weighted entropy
sum_i size_i (w_i log w_i - w_i) with w_i at most `limit`, under one token
constraint per source, sum_{i in s} size_i w_i = T_s, and one on document
length: the mix shall have the mean length class of the input's tokens (the
class of a document is the number of binary digits of its size).  Sources whose
documents are longer or shorter than others would shift it, so documents of
all sources are tilted against the shift: w_i = min(limit, exp(l_s + m c_i)).
The multiplier m is kept within `tilt`, the price at which the length
constraint, which may be out of reach, gives way; those of sources don't.

Documents are summed once into (source, class) cells.  For a given m every
source's l_s solves its constraint inside its row, by Newton steps on a
piecewise linear function that end after at most as many steps as there are
classes.  m itself takes Newton steps on what is left of the convex dual; its
slope and curvature are one distributed sum over sources per step, and two
numbers reach the driver.

Rates are rounded into copies: whole repeats for all documents of a cell, and
one more for those that come first in a hash order until the cell's words are
used up, the last of them in part.  Cells of a source are rounded by running
sums, so the source comes to the whole number nearest its target.  Running
sums over the order are two-level (ranges of the hash, then rows), so a source
that holds a third of all documents is split.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, LIMIT = 1.5, 2.0
#: Newton steps of the length multiplier and the most that it may be: a document twice as long has at most exp(TILT) times the rate.
STEPS, TILT = 14, 0.5
#: Length classes: sizes have at most so many binary digits.
CLASSES = 63
#: Hex digits of the hash that cut a source's order into ranges.
DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """sources (source, source_size) with target.

    Weights repeat over the sources by code point, null last.  Targets share
    `share` of all sizes by weight but stop at `limit` times the source's
    size; the excess is shared again.  Sorted by the level at which they stop,
    sources fill up one after the other: with the first k stopped the level of
    the others is (total - stopped) / (weights left), and a source has stopped
    where its own level lies at or below that.
    """
    k = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weighed = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (k % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("_stop", F.lit(limit) * F.col("source_size")).withColumn("_level", F.col("_stop") / F.col("_weight"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy("_level", F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        weighed.withColumn("_total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("_left", F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_spent", F.coalesce(F.sum("_stop").over(before), F.lit(0.0)))
    )
    # A source stops if it would be over its limit once all before it have stopped.
    ranked = ranked.withColumn("_common", (F.col("_total") - F.col("_spent")) / F.col("_left")).withColumn("_open", F.col("_level") > F.col("_common"))
    level = F.first(F.when(F.col("_open"), F.col("_common")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("_final", level).select("source", "source_size", F.when(F.col("_open"), F.col("_final") * F.col("_weight")).otherwise(F.col("_stop")).cast("double").alias("target"))


def length_class(size: Column) -> Column:
    """Binary digits of the size."""
    return F.length(F.bin(size)).cast("int")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _solved(sources: DataFrame, tilt: float, limit: float) -> DataFrame:
    """sources (cells: sizes by class, target) with z: exp of the source's multiplier under the length multiplier `tilt`; null where the limit or nothing is taken of all."""
    pull = F.transform("cells", lambda x: F.exp(F.lit(tilt) * x["c"]))
    held = sources.withColumn("_a", pull).withColumn("_p", F.zip_with("cells", "_a", lambda x, a: x["n"] * a))
    step = lambda z: z + (
        F.col("target") - _total(F.zip_with("cells", "_a", lambda x, a: x["n"] * F.least(F.lit(limit), z * a)))
    ) / _total(F.zip_with("_p", "_a", lambda p, a: F.when(z * a < limit, p).otherwise(F.lit(0.0))))
    inside = (F.col("target") > 0) & (F.col("target") < F.lit(limit) * F.col("source_size"))
    return held.withColumn("z", F.when(inside, F.aggregate("cells", F.col("target") / _total(F.col("_p")), lambda z, _: step(z))))


def _rate(z: Column, a: Column, limit: float) -> Column:
    return F.when(z.isNotNull(), F.least(F.lit(limit), z * a)).when((F.col("target") > 0) & (F.col("source_size") > 0), F.lit(limit)).otherwise(F.lit(0.0))


def length_multiplier(sources: DataFrame, steps: int = STEPS, tilt: float = TILT, limit: float = LIMIT) -> float:
    """The multiplier of the length constraint, by Newton steps on the dual that keep to the bracket known so far."""
    mean = sources.select(F.explode("cells").alias("x")).agg((F.sum(F.col("x.n") * F.col("x.c")) / F.sum("x.n")).cast("double")).first()[0]
    if mean is None:
        return 0.0
    at, lo, hi = 0.0, -tilt, tilt
    for _ in range(steps):
        held = _solved(sources, at, limit)
        terms = F.zip_with("cells", "_a", lambda x, a: F.struct((x["n"] * _rate(F.col("z"), a, limit)).alias("w"), (x["c"] - mean).alias("d"), (F.col("z") * a < limit).alias("free")))
        free = lambda f: _total(F.transform("_t", lambda x: F.when(x["free"], f(x)).otherwise(F.lit(0.0))))
        parts = held.withColumn("_t", terms).select(_total(F.transform("_t", lambda x: x["w"] * x["d"])).alias("g"), free(lambda x: x["w"]).alias("n"), free(lambda x: x["w"] * x["d"]).alias("s"), free(lambda x: x["w"] * x["d"] * x["d"]).alias("q"))
        sums = parts.agg(F.sum("g").alias("g"), F.sum(F.when(F.col("n") > 0, F.col("q") - F.col("s") * F.col("s") / F.col("n")).otherwise(F.lit(0.0))).alias("h")).first()
        lo, hi = (lo, at) if sums["g"] > 0 else (at, hi)
        to = at - sums["g"] / sums["h"] if sums["h"] > 0 else at
        to = to if lo <= to <= hi else (lo if to < lo and lo == -tilt else hi if to > hi and hi == tilt else (lo + hi) / 2)
        at, before = to, at
        if abs(at - before) < 1e-13:
            break
    return at


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    tilt: float = TILT,
    carry: str | None = None,
) -> DataFrame:
    """(id, source, size, source_size, target, rate, taken, copies) per row of docs; carry names a struct of the whole row to go along.

    size: words of the text, 0 for null and empty.  rate: the document's
    exponentially tilted rate.  taken: words the mix takes, repeats counted,
    at most limit times size; copies: how often the document is written, the
    last time perhaps in part.  The taken words of a source come to the whole
    number nearest its target.  Reruns agree.  Null sources form one source;
    rows that share an id are documents of their own, and equal rows among
    them take alike or differ by a tie of the order.  Empty tables give empty
    results.
    """
    order = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(carry)] if carry else []
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), order.alias("_h"), *row)
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # never null, so that joins by it need no exchange of their own
    slim = slim.withColumn("_key", key).withColumn("_class", length_class(F.col("size"))).withColumn("_range", F.substring("_h", 1, DIGITS))
    narrow = slim.drop(carry) if carry else slim
    ranges = cut(narrow.groupBy("_key", "_class", "_range").agg(F.sum("size").alias("_in"), F.first("source").alias("source")))
    by_class = ranges.groupBy("_key", "_class").agg(F.sum("_in").cast("double").alias("n"), F.first("source").alias("source"))
    # At most CLASSES cells of a source.
    sources = by_class.groupBy("_key").agg(F.first("source").alias("source"), F.sum("n").cast("long").alias("source_size"), F.array_sort(F.collect_list(F.struct(F.col("_class").alias("c"), "n"))).alias("cells"))
    aimed = targets(sources.select("source", "source_size"), weights, share, limit).withColumn("_key", key).select("_key", "target")
    sources = cut(sources.join(aimed, "_key"))
    held = _solved(sources, length_multiplier(sources, tilt=tilt, limit=limit), limit)
    rated = held.select("_key", "source_size", "target", F.explode(F.zip_with("cells", "_a", lambda x, a: F.struct(x["c"].alias("_class"), x["n"].cast("long").alias("_cell"), _rate(F.col("z"), a, limit).alias("rate")))).alias("x")).select("_key", "source_size", "target", "x.*")
    whole = F.floor("rate").cast("long")
    # The words beyond whole copies, rounded as a running sum over the classes.
    along = Window.partitionBy("_key").orderBy("_class").rowsBetween(Window.unboundedPreceding, 0)
    rest = rated.withColumn("_sum", F.sum((F.col("rate") - whole) * F.col("_cell")).over(along))
    last = F.lag(F.round("_sum"), 1, 0.0).over(Window.partitionBy("_key").orderBy("_class"))
    rated = rest.withColumn("_extra", (F.round("_sum") - last).cast("long")).drop("_sum")
    ahead = F.sum("_in").over(Window.partitionBy("_key", "_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    plan = ranges.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).drop("_in", "source").join(rated, ["_key", "_class"])
    inside = Window.partitionBy("_key", "_class", "_range").orderBy("_h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = slim.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ordered.join(plan, ["_key", "_class", "_range"])
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_extra") - F.col("_ahead") - F.col("_before")))
    taken = (whole * F.col("size") + part).cast("long")
    return joined.select("id", "source", "size", "source_size", "target", "rate", taken.alias("taken"), F.when(F.col("size") > 0, F.ceil(taken / F.when(F.col("size") > 0, F.col("size")))).otherwise(0).cast("int").alias("copies"), *([carry] if carry else []))
