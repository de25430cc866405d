"""Source divergence audit: how far the word use of a language's sources lies apart, and on which terms.

Each task counts terms by (lang, source); the counts are dealt into shards by
the hash of (lang, term), where DuckDB adds them up and keeps the terms with
enough documents.  A term is whole in one shard, so smoothed shares and their
differences are summed per shard by SQL over columns; Spark adds the shards'
partial sums of each pair of sources and ranks the terms that lead in each.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _cluster as cl

#: Documents of its language that a term must occur in; what is added to every count; the whole that shares are whole numbers of.
LEAST_DOCS, ADDED, WHOLE = 30, 5, 1_000_000_000
#: Terms listed per group.
TOP = 50
#: Different (group, term) counts that a task holds before it passes them on.
HELD = 200_000
#: Text whose term counts one shard adds up.
SHARD_BYTES = 8 << 20
#: Shares of a shard in the comparison, every group by every kept term; at least LEAST_SHARDS shards.
SHARES, LEAST_SHARDS = 500_000, 16
#: Memory of DuckDB in a task; a shard's rows take a fraction of it.
MEMORY = "300MB"

#: Letters, A-Z lowered, and every byte of other code points stay; the rest is space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_SUMS = f"""
SELECT lang, source, term, n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS opens FROM (
  SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM counted GROUP BY ALL
) QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {LEAST_DOCS}
"""

#: groups: (lang, source, total, terms), source null for the language itself; kept: (lang, source, term, n).
_SHARES = f"""
CREATE TEMP TABLE shares AS
SELECT t.lang, t.term, g.source, coalesce(k.n, 0) AS n,
  (1 + {WHOLE}::HUGEINT * (CASE WHEN g.source IS NULL THEN t.n ELSE coalesce(k.n, 0) END + {ADDED}) // (g.total + {ADDED}::HUGEINT * g.terms))::BIGINT AS p
FROM (SELECT lang, term, sum(n) AS n FROM kept GROUP BY ALL) t JOIN groups g ON g.lang = t.lang
LEFT JOIN kept k ON k.lang = t.lang AND k.term = t.term AND k.source = g.source
"""
_PAIRS = """
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
"""
_LEADS = f"""
SELECT a.lang, a.source, 'term' AS part, a.term AS item, a.p - q.p AS value
FROM shares a JOIN shares q ON q.lang = a.lang AND q.term = a.term AND q.source IS NULL
WHERE a.source IS NOT NULL AND a.n > 0 AND a.p > q.p
QUALIFY row_number() OVER (PARTITION BY a.lang, a.source ORDER BY a.p - q.p DESC, a.term) <= {TOP}
"""


def _duck():
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET threads = 1; SET memory_limit = '{MEMORY}'; SET temp_directory = ''")
    return con


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed as far as a task sees; null text, lang and source are empty."""
    cl.ship(docs.sparkSession)

    def flush(counts: dict):
        for (of, by), (n, d) in counts.items():
            terms = list(n)
            for lo in range(0, len(terms), 100_000):
                some = terms[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(some), pa.string()), pa.array([by] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([d[t] for t in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        cl.release()
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        have = 0
        for batch in batches:
            raw = batch.column(2).cast(pa.large_binary())
            for of, by, text_of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw, strict=True):
                terms = text_of.as_py().translate(_FOLD).split()
                n, d = counts.setdefault((of, by), (Counter(), Counter()))
                have -= len(n)
                n.update(terms)
                d.update(set(terms))
                have += len(n)
                if have >= held:
                    yield from flush(counts)
                    counts, have = {}, 0
        yield from flush(counts)
        counts.clear()
        cl.release()

    filled = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    return filled.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value long, rank int).

    part 'pair': item is another source of the language, value the sum over
    the kept terms of |p - q|, 0 where the language keeps none.  part 'term':
    item is a kept term that the source holds and uses more than its language
    does, value p - q, the TOP largest.  p is the source's smoothed share of
    the term in parts of WHOLE, q that of the other source or of the language.
    Ranks run from the largest value; ties go by the bytes of item.

    Null text, lang and source are empty strings, and one with those.  A source
    without terms is a group like any other.  A language of one source has no
    pair.  Repeated rows count as often as they occur.  Extra columns are left
    alone; an empty table gives no row.
    """
    spark = docs.sparkSession
    shards = max(cl.shuffle_partitions(spark), -(-cl.text_bytes(docs, f"`{text}`") // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard")

    def add(table: pa.Table) -> pa.Table:
        cl.release()
        with _duck() as con:
            con.register("counted", table)
            return con.sql(_SUMS).to_arrow_table().cast(kept_schema)

    kept_schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("opens", pa.bool_())])
    kept = cl.cut(count_terms(docs, text, lang, source).select(shard, "*").groupBy("shard").applyInArrow(add, "lang string, source string, term string, n long, opens boolean"))

    here = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("opens").cast("long")).alias("terms"))
    own = here.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    of_lang = Window.partitionBy("lang")  # a row per source
    own = cl.cut(own.withColumn("all", F.sum("total").over(of_lang)).withColumn("terms", F.sum("terms").over(of_lang)))
    groups = own.select("lang", "source", "total", "terms").unionByName(own.groupBy("lang").agg(F.first("all").alias("total"), F.first("terms").alias("terms")).withColumn("source", F.lit(None).cast("string")))
    # A shard gives a partial sum for every two sources, so there are no more shards than the shares need.
    dealt = max(LEAST_SHARDS, -(-int(own.agg(F.sum("terms")).first()[0] or 0) // SHARES))
    told = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1)))).where("terms > 0")
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(dealt)).cast("int").alias("shard")

    def compare(kept_rows: pa.Table, group_rows: pa.Table) -> pa.Table:
        if not kept_rows.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in found_schema}, schema=found_schema)
        cl.release()
        with _duck() as con:
            con.register("kept", kept_rows.select(["lang", "source", "term", "n"]))
            con.register("groups", group_rows)
            con.execute(_SHARES)
            return pa.concat_tables([con.sql(q).to_arrow_table().cast(found_schema) for q in (_PAIRS, _LEADS)])

    found_schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    found = kept.select(shard, "*").groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(compare, "lang string, source string, part string, item string, value long")
    found = cl.cut(found)

    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # The report lists every two sources of a language, those of languages without a kept term too.
    others = own.where("terms = 0")
    none = others.select("lang", "source").join(others.select("lang", F.col("source").alias("item")), "lang").where("source < item").withColumn("value", F.lit(0).cast("long"))
    both = sums.unionByName(none.select("lang", "source", "item", "value"))
    pairs = both.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    leads = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", rank).unionByName(leads).select("lang", "source", "part", "item", "value", "rank")
