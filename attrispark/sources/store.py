"""Folders shared by driver and executors: tables written and read again as Parquet, CSV or JSON, and game values kept by their parameters."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

FORMS = ("parquet", "csv", "json")
#: What stands for null in CSV files; the same text as a value is read as null.
NULL = "\\N"


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only in local mode, where driver and executors are one process, a folder of this machine, removed when it ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="attrispark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


_LOCAL: list[str] = []


def save(table: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes the rows in place of what the folder holds; CSV files have a header line and NULL for null; values with line feeds are quoted, so a CSV file is read as a whole."""
    if form not in FORMS:
        raise ValueError(f"no form {form!r}; there are {', '.join(FORMS)}")
    options = {"header": True, "nullValue": NULL, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False} if form == "csv" else {"ignoreNullFields": False} if form == "json" else {}
    table.write.mode("overwrite").options(**options).format(form).save(path)


def load(spark: SparkSession, path: str, form: str, schema) -> DataFrame:
    """What `save` wrote; bad rows raise."""
    if form not in FORMS:
        raise ValueError(f"no form {form!r}; there are {', '.join(FORMS)}")
    options = {"header": True, "emptyValue": "", "nullValue": NULL, "escape": '"', "multiLine": True, "mode": "FAILFAST"} if form == "csv" else {"mode": "FAILFAST"} if form == "json" else {}
    return spark.read.schema(schema).options(**options).format(form).load(path)


def kept(spark: SparkSession, folder: str, build: Callable[[], DataFrame], **parameters) -> DataFrame:
    """The rows of build(), written once per set of parameters and read from then on.

    Parameters must name everything that the rows depend on.  Rows are written
    aside and moved in place when they are whole, so a lost job leaves none.
    """
    name = sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:32]
    paths = spark._jvm.org.apache.hadoop.fs.Path
    path, aside = paths(f"{folder}/game-{name}"), paths(f"{folder}/.game-{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        build().write.parquet(aside.toString())
        if files.exists(path) or not files.rename(aside, path):
            files.delete(aside, True)  # another session was first
    return spark.read.parquet(path.toString())
