"""A training-data pipeline over documents, five operators long.

Each stage takes what the one before it kept, as (spark, docs, sf_dir), and
returns a DataFrame; stages are written as Parquet in the shared folder and
read again, so a lost executor costs at most the stage it worked on.  All but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrispark.llm._cluster import shared_folder
from attrispark.llm.mixing import mix_sources
from attrispark.llm.packing import pack_documents
from attrispark.llm.perplexity import keep_quality
from attrispark.llm.queries import tokenizer_path
from attrispark.llm.simhash import dedup_simhash
from attrispark.llm.substrings import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest id."""
    return dedup_simhash(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds go; documents without a word left go with them."""
    kept = dedup_substrings(docs.select(*COLUMNS))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    return kept.where(~changed | (F.col("n_removed") < F.col("n_words"))).select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the mix takes it.

    The last copy of one document per source and length class is taken in part: its first words.
    Copies keep the document's id and are full repeats otherwise.
    """
    mixed = mix_sources(docs.select(*COLUMNS), carry="row").where("copies > 0 or size = 0").select("row.*", "size", "taken", "copies")
    each = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "copies"))))
    left = F.col("taken") - (F.col("_copy") - 1) * F.col("size")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), left.cast("int")), " ")
    cut = (left < F.col("size")) & (F.col("size") > 0)
    return each.select("doc_id", F.when(cut, head).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.char_length(head).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece of a document and its place."""
    return pack_documents(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packing),
]

#: SQL has neither the perplexity model, nor components, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    folder = shared_folder(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for k, (_, stage) in enumerate(STAGES):
        to = f"{folder}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
        if k:
            _remove(spark, before)
        before = to
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes a stage's rows once those of the next one are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
