"""License scans by canonical digest lookup.

Whole texts are reduced to a canonical wording (case, punctuation, copyright
and title lines, equivalent spellings), digested, and hash-joined to the
digests of known licences.  The list of known licences is a parameter of the
package, so the side that is broadcast has the size of a file in it.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import SPELLINGS, TEXTS, TITLES

#: A line that only says whose the text is.
COPYRIGHT_LINE = r"(?m)^[^\n\p{L}\p{N}]*(copyright|\(c\)|©|&copy;|all rights reserved|portions copyright|spdx-)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical wording: lower-case words with single spaces, a space at either end."""
    kept = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    words = F.concat(F.lit(" "), F.regexp_replace(kept, NOT_WORD, " "), F.lit(" "))
    words = F.regexp_replace(words, "  +", " ")
    return reduce(lambda t, pair: F.replace(t, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, words)


def untitled(words: Column) -> Column:
    """Without a licence title at the start."""
    return F.regexp_replace(words, "^ (" + "|".join(sorted(TITLES, key=len, reverse=True)) + ") ", " ")


def digest(text: Column) -> Column:
    return F.sha2(untitled(canonical(text)).cast("binary"), 256)


def known_licenses(spark, texts: dict[str, str] = TEXTS) -> DataFrame:
    """(license, digest); of licences with one wording the first by name stands for all."""
    rows = spark.createDataFrame(sorted(texts.items()), "name string, text string")
    return rows.select(digest(F.col("text")).alias("_digest"), "name").groupBy("_digest").agg(F.min("name").alias("license_id"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] = TEXTS) -> DataFrame:
    """(id, digest, license_id, is_license) per row: the licence whose whole text the row's text is, null where it is none.

    Null and empty texts, and texts of nothing but copyright lines, have the
    digest of an empty wording and are no licence.  Rows that share an id keep
    a row each; other columns are not carried.  Empty tables give empty
    results.
    """
    found = docs.select(F.col(f"`{id_col}`").alias("id"), digest(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("digest"))
    known = known_licenses(docs.sparkSession, texts)
    joined = found.join(F.broadcast(known), F.col("digest") == F.col("_digest"), "left")
    return joined.select("id", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def scan_sql(texts: dict[str, str] = TEXTS) -> str:
    """The same in DuckDB SQL over documents."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        kept = f"regexp_replace(lower({text}), {quoted(COPYRIGHT_LINE)}, ' ', 'g')"
        words = f"regexp_replace(' ' || regexp_replace({kept}, {quoted(NOT_WORD)}, ' ', 'g') || ' ', '  +', ' ', 'g')"
        words = reduce(lambda t, pair: f"replace({t}, ' {pair[0]} ', ' {pair[1]} ')", SPELLINGS, words)
        titles = "|".join(sorted(TITLES, key=len, reverse=True))
        return f"sha256(regexp_replace({words}, '^ ({titles}) ', ' '))"

    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(texts.items()))
    return f"""
WITH known AS (
  SELECT {form("text")} AS digest, min(name) AS license_id FROM (VALUES {values}) AS t(name, text) GROUP BY 1
), d AS (
  SELECT doc_id, {form("coalesce(text, '')")} AS digest FROM documents
)
SELECT doc_id, d.digest, license_id, license_id IS NOT NULL AS is_license FROM d LEFT JOIN known ON d.digest = known.digest
"""
