"""Quality classifier: perplexity under an interpolated modified Kneser-Ney character n-gram model of trusted text.

Trusted text is every document labelled good and not toxic; one in HOLDOUT is
kept out of the model to set thresholds.  The n-gram counts of the others are
gathered per block, summed, and turned into the model by aggregations over
n-gram types: continuation counts order by order, discounts from the counts of
counts, and per context the mass left to the lower order.  Scoring joins
sharded: each block asks the shards of the n-gram hash space for the terms of
its distinct n-grams and interpolates them itself, so neither the model nor
the corpus is ever in one place.  A document is rejected where its perplexity
exceeds a quantile of its language's held-out trusted documents.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _cluster as cl
from . import _words as w

ORDER = 5
#: Bits of a symbol.  Code points from NEAR on take two symbols, so that no two share one: their upper bits beyond NEAR, then their lower FAR_BITS.
BITS, NEAR, FAR_BITS = 12, 3550, 11
#: One trusted document in so many is kept out of the model; thresholds come from these.
HOLDOUT = 8
#: Quantile of held-out perplexities, and what its logarithm is multiplied by before a document is rejected: 1 is the quantile itself.
QUANTILE, SLACK = 0.99, 1.0
#: A text of n characters may exceed the threshold on log perplexity by this over the root of n: two deviations of a mean of n terms.
SHORT = 4.0
#: Fewer held-out documents than this have no such quantile; it is then estimated from their mean and deviation.
FEW = 50
#: Larger blocks repeat fewer n-grams.
BLOCK_BYTES = 24 << 20
_SYMBOLS = 1 << BITS


def symbols(text: bytes) -> np.ndarray:
    """Symbols of a text's code points, from 1; 0 pads the start.  Different texts have different symbols."""
    cp = np.frombuffer(text.decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    far = cp >= NEAR
    if not far.any():
        return cp + np.uint64(1)
    at = np.arange(len(cp)) + np.cumsum(far) - far
    out = np.zeros(len(cp) + int(far.sum()), np.uint64)
    out[at] = np.where(far, NEAR + (cp >> np.uint64(FAR_BITS)), cp)
    out[at[far] + 1] = cp[far] & np.uint64((1 << FAR_BITS) - 1)
    return out + np.uint64(1)


def _chunks(texts: list[bytes], order: int):
    """(first text, n-gram at each symbol, symbols of each text) for runs of texts."""
    for first, _, data, offsets in w.batches(texts):
        parts = [symbols(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        pad = np.zeros(order - 1, np.uint64)
        s = np.concatenate([x for p in parts for x in (pad, p)])
        gram = s.copy()
        for back in range(1, order):
            gram[back:] |= s[:-back] << np.uint64(BITS * back)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes + order - 1)
        text = np.ones(len(s), bool)
        for k in range(order - 1):
            text[ends - sizes - 1 - k] = False
        yield first, gram[text], sizes


def _types(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts in order, and their counts."""
    grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held_g, held_c, held = [grams], [counts], 0
    for _, gram, _ in _chunks(texts, order):
        g, c = np.unique(gram, return_counts=True)
        held_g.append(g)
        held_c.append(c)
        held += len(g)
        if held > 1 << 21:
            held_g, held_c = ([x] for x in _summed(np.concatenate(held_g), np.concatenate(held_c)))
            held = 0
    return _summed(np.concatenate(held_g), np.concatenate(held_c))


def _summed(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, place = np.unique(g, return_inverse=True)
    return u, np.bincount(place, weights=c, minlength=len(u)).astype(np.int64)


def _keys(grams: np.ndarray, order: int) -> np.ndarray:
    """The hash that deals an n-gram of the order to its shard; a bijection of its symbols."""
    return w.mix(grams ^ np.uint64(order << 60))


def _lower(grams: np.ndarray, order: int) -> np.ndarray:
    """The n-gram without its first symbol."""
    return grams & np.uint64((1 << (BITS * (order - 1))) - 1)


def _asked(grams: np.ndarray, order: int):
    """(order, distinct n-grams): every lower-order n-gram that scoring the given ones can need, as ending or as context."""
    ends = grams
    need = {order: grams}
    for n in range(order, 0, -1):
        context = np.unique(ends >> np.uint64(BITS))
        if n > 1:
            ends = np.unique(_lower(ends, n))
            need[n - 1] = np.union1d(ends, context)
    return need


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Sharded terms (ord, gram, alpha, gamma) from counts (gram, c) of the highest order.

    alpha: the discounted share of the n-gram in its context, null where it
    wasn't met.  gamma: the mass its continuations leave to the lower order,
    null where it wasn't met as a context.
    """
    level, terms = cl.cut(counts.groupBy("gram").agg(F.sum("c").alias("c"))), None
    for n in range(order, 0, -1):
        stats = level.agg(*[F.sum(F.when(F.col("c") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = (float(stats[f"n{k}"] or 0) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [max(0.0, min(k - 1e-3, k - (k + 1) * y * b / a)) if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        held = F.when(F.col("c") == 1, F.lit(d[0])).when(F.col("c") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
        own = level.select("gram", F.shiftright("gram", BITS).alias("context"), "c", held.alias("d"))
        context = own.groupBy("context").agg(F.sum("c").alias("all"), F.sum("d").alias("left"))
        alpha = own.join(context, "context").select(F.lit(n).alias("ord"), "gram", ((F.col("c") - F.col("d")) / F.col("all")).alias("alpha"), F.lit(None).cast("double").alias("gamma"))
        gamma = context.select(F.lit(n - 1).alias("ord"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("alpha"), (F.col("left") / F.col("all")).alias("gamma"))
        found = alpha.unionByName(gamma)
        terms = found if terms is None else terms.unionByName(found)
        if n > 1:
            level = cl.cut(level.groupBy((F.col("gram").bitwiseAND((1 << (BITS * (n - 1))) - 1)).alias("gram")).agg(F.count("*").alias("c")))
    return terms.groupBy("ord", "gram").agg(F.max("alpha").alias("alpha"), F.max("gamma").alias("gamma"))


def score_perplexity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Columns of docs with perplexity (null where the text is null or empty) and held_out (trusted, but kept out of the model).

    Trusted: labelled quality 1 and toxic 0.

    A column of docs with one of these names gives way.  Without trusted text
    every symbol is equally likely.  Labels repeated for an id count once;
    an id labelled both ways isn't trusted.  A null id is never trusted.
    """
    spark = docs.sparkSession
    cl.ship(spark)
    total = cl.text_bytes(docs, text_col)
    slices = cl.slices_for(spark, total)
    blocks_n = max(1, min(slices, -(-total // (4 << 20))), -(-total // BLOCK_BYTES))
    deal = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(blocks_n)).cast("int").alias("_blk")
    blocks = cl.squeezed(docs.select(deal(F.col(id_col)), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    trusted = labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t")).where("q = 1 and t = 0 and doc_id is not null")
    trusted = trusted.select(deal(F.col("doc_id")), F.col("doc_id").cast("long").alias("trusted_id"), (F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HOLDOUT)) == 0).alias("out"))
    computed = ("perplexity", "held_out")
    out = T.StructType([f for f in docs.schema.fields if f.name not in computed] + [T.StructField("perplexity", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_type as to_arrow

    def gather(table: pa.Table, ids: pa.Table) -> pa.Table:
        good = set(ids.column("trusted_id").to_pylist())
        if not table.num_rows or not good:
            return pa.table({"gram": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
        row, texts, _ = cl.rows_of(table, id_col, text_col)
        g, c = _types([t for t, i in zip(texts, row.column(id_col).to_pylist(), strict=True) if i in good], order)
        return pa.table({"gram": pa.array(g.view(np.int64)), "c": pa.array(c)})

    def ask(table: pa.Table) -> pa.Table:
        _, texts, _ = cl.rows_of(table, id_col, text_col)
        need = _asked(_types(texts, order)[0], order)
        parts: dict[int, list[np.ndarray]] = {}
        for n, grams in need.items():
            keys = np.sort(_keys(grams, n))
            for s, lo, hi in cl.by_slice(keys, slices):
                mine = parts.setdefault(s, [np.zeros(0, np.uint64)] * (2 * order))
                mine[2 * n - 2 : 2 * n] = [keys[lo : lo + 1], cl.deltas(keys[lo:hi])]
        block = table.column("_blk")[0].as_py()
        return cl.requests_table([(block, s, cl.pack(*p)) for s, p in parts.items()])

    def deal_terms(batches):
        for batch in batches:
            n = batch.column(0).to_numpy().astype(np.int64)
            gram = batch.column(1).to_numpy().view(np.uint64)
            key = w.mix(gram ^ (n.astype(np.uint64) << np.uint64(60)))
            yield pa.RecordBatch.from_arrays([pa.array(cl.slice_of(key, slices), pa.int32()), pa.array(n), pa.array(key.view(np.int64)), batch.column(2), batch.column(3)], names=["_slc", "ord", "key", "alpha", "gamma"])

    def answer(requests: pa.Table, terms: pa.Table) -> pa.Table:
        if not requests.num_rows:
            return cl.replies_table([])
        s = requests.column("_slc")[0].as_py()
        level = terms.column("ord").to_numpy() if terms.num_rows else np.zeros(0, np.int64)
        key = terms.column("key").to_numpy().view(np.uint64) if terms.num_rows else np.zeros(0, np.uint64)
        value = [np.nan_to_num(terms.column(c).to_numpy(zero_copy_only=False).astype(np.float32) if terms.num_rows else np.zeros(0, np.float32), nan=none) for c, none in (("alpha", 0), ("gamma", 1))]
        sorted_terms = {}
        for n in range(1, order + 1):
            at = np.flatnonzero(level == n)
            at = at[np.argsort(key[at])]
            sorted_terms[n] = key[at], value[0][at], value[1][at]
        rows = []
        for b, p in cl.requests_of(requests):
            found = []
            for n in range(1, order + 1):
                asked = cl.undelta(int(p[2 * n - 2][0]), p[2 * n - 1]) if len(p[2 * n - 1]) else np.zeros(0, np.uint64)
                keys, alpha, gamma = sorted_terms[n]
                at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
                met = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
                found.append(np.where(met, alpha[at] if len(keys) else 0, 0).astype(np.float32))
                found.append(np.where(met, gamma[at] if len(keys) else 1, 1).astype(np.float32) if n < order else np.zeros(0, np.float32))
            rows.append((s, b, 1, cl.pack(*found)))
        return cl.replies_table(rows)

    def score(table: pa.Table, replies: pa.Table, none: float, floor: float) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], to_arrow(f.dataType)) for f in out.fields})
        row, texts, _ = cl.rows_of(table, id_col, text_col)
        grams, _ = _types(texts, order)
        answers, terms = cl.replies_of(replies, 1), {}
        for n, g in _asked(grams, order).items():
            keys = _keys(g, n)
            by = np.argsort(keys)
            alpha, gamma = np.zeros(len(g), np.float32), np.ones(len(g), np.float32)
            for s, lo, hi in cl.by_slice(keys[by], slices):
                alpha[by[lo:hi]] = answers[s][2 * n - 2]
                if n < order:
                    gamma[by[lo:hi]] = answers[s][2 * n - 1]
            terms[n] = g, alpha.astype(np.float64), gamma.astype(np.float64)

        def probability(g: np.ndarray, n: int) -> np.ndarray:
            lower = probability(_lower(g, n), n - 1) if n > 1 else np.full(len(g), floor)
            if n > 1:
                known, _, gamma = terms[n - 1]
                left = gamma[np.searchsorted(known, g >> np.uint64(BITS))]
            else:
                left = none
            known, alpha, _ = terms[n]
            return alpha[np.searchsorted(known, g)] + left * lower

        log = np.log(probability(grams, order)) if len(grams) else np.zeros(0)
        result = []
        for _, gram, sizes in _chunks(texts, order):
            u, place = np.unique(gram, return_inverse=True)
            each = log[np.searchsorted(grams, u)][place] if len(u) else np.zeros(0)
            ends = np.cumsum(sizes)
            total_log = np.concatenate([[0.0], np.cumsum(each)])
            sums = total_log[ends] - total_log[ends - sizes]
            result += [float(np.exp(-s / n)) if n else None for s, n in zip(sums.tolist(), sizes.tolist(), strict=True)]
        cols = {"perplexity": pa.array(result, pa.float64())}
        return pa.Table.from_arrays([cols[f.name] if f.name in cols else row.column(f.name) for f in out.fields], names=[f.name for f in out.fields])

    counts = blocks.groupBy("_blk").cogroup(trusted.where("not out").groupBy("_blk")).applyInArrow(gather, "gram long, c long")
    terms = cl.cut(model(counts, order))
    empty = terms.where("ord = 0").agg(F.max("gamma")).first()[0]
    # An unmet symbol gets an equal share of what the single symbols leave.
    left, floor = (1.0 if empty is None else float(empty)), 1.0 / _SYMBOLS
    dealt_terms = terms.where("ord > 0").select(F.col("ord").cast("long"), "gram", "alpha", "gamma").mapInArrow(deal_terms, "_slc int, ord long, key long, alpha double, gamma double")
    replies = cl.ask(blocks, ask).groupBy("_slc").cogroup(dealt_terms.groupBy("_slc")).applyInArrow(answer, cl.REPLY)

    def scored(table: pa.Table, told: pa.Table) -> pa.Table:
        return score(table, told, left, floor)

    found = cl.told(blocks, replies, scored, out)
    ids = trusted.where("out").select(F.col("trusted_id").alias("_trusted_id"))
    joined = found.join(ids, found[id_col].cast("long") == ids["_trusted_id"], "left")
    return joined.select(*[F.col(f"`{f.name}`") for f in out.fields if f.name not in computed], "perplexity", F.col("_trusted_id").isNotNull().alias("held_out"))


def _bound(n: Column, mean: Column, deviation: Column, quantile: float) -> Column:
    """What a further value exceeds with chance 1 - quantile, from n normal values; null for fewer than two."""
    z, v = NormalDist().inv_cdf(quantile), n - 1
    t = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3)
    return F.when(n > 1, mean + t * deviation * F.sqrt(1 + 1 / n))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(id, perplexity, threshold, kept) per row: rejected where the perplexity exceeds the document's threshold.

    Log threshold: slack times the language's quantile of held-out log
    perplexities, each less SHORT / sqrt(characters), plus the document's own
    SHORT / sqrt(characters).  A language with fewer than FEW held-out
    documents (null among them) takes the bound for a further document by
    their mean and deviation, or the overall quantile if that is less, but no
    less than its own sample quantile; the overall quantile is such a bound
    too where all held-out documents are fewer than FEW.  Without any,
    everything with text is kept.  Null and empty texts have no perplexity and
    are rejected.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.char_length(F.col(f"`{text_col}`")).alias("n"))
    scored = cl.cut(score_perplexity(slim, labels, "id", "text", order).select("id", "lang", "perplexity", "held_out", (F.lit(SHORT) / F.sqrt(F.greatest("n", F.lit(1)))).alias("short")))
    good = scored.where("held_out and perplexity is not null").withColumn("p", F.log("perplexity") - F.col("short"))
    found = [F.percentile_approx("p", quantile, 100_000).alias("own"), F.count("*").alias("n"), _bound(F.count("*"), F.avg("p"), F.stddev_samp("p"), quantile).alias("bound")]
    by_lang = good.groupBy(F.col("lang").alias("_lang")).agg(*found)
    overall = good.agg(*found).first()
    overall = overall["own"] if overall["n"] >= FEW or overall["bound"] is None else max(overall["own"], overall["bound"])
    joined = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    least = F.when(F.col("n") >= FEW, F.col("own")).otherwise(F.greatest("own", F.least("bound", F.lit(overall).cast("double"))))
    threshold = F.exp(least * slack + F.col("short"))
    return joined.select("id", "perplexity", threshold.alias("threshold")).withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs that the classifier keeps.

    Rows that share an id share the verdict of the best of them; rows with a
    null id are judged each by its own text and language.
    """
    unnamed = F.col(f"`{id_col}`").isNull()
    if not docs.where(unnamed).limit(1).count():
        kept = classify_quality(docs, labels, id_col, text_col, lang_col, **options).where("kept").select(F.col("id").alias("_kept_id")).distinct()
        return docs.join(kept, docs[id_col] == kept["_kept_id"], "left_semi")
    # A text without an id goes by a digest of what it is judged by; labels know no such id.
    key = F.sha2(F.to_json(F.struct(F.col(f"`{id_col}`").alias("i"), F.when(unnamed, F.col(f"`{text_col}`")).alias("t"), F.when(unnamed, F.col(f"`{lang_col}`")).alias("l"))), 256)
    number = F.when(unnamed, F.xxhash64(key)).otherwise(F.col(f"`{id_col}`").cast("long"))
    slim = docs.select(number.alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    kept = classify_quality(slim, labels, "id", "text", "lang", **options).where("kept").select(F.col("id").alias("_kept_id")).distinct()
    return docs.withColumn("_kept_key", number).join(kept, F.col("_kept_key") == kept["_kept_id"], "left_semi").drop("_kept_key")
