"""Helpers shared by the corpus operators: table access, shared storage, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and TAB..CR.
BLANKS = " \t\n\x0b\x0c\r"
#: A word, for Python's and Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's own reader touches the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset (tests
    in one local JVM) a temporary folder is made and remembered.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(shared_dir, "local", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = shared_dir.local = tempfile.mkdtemp(prefix="marlstone-")
    return folder.rstrip("/")


#: Tables that this process has written and not yet deleted, oldest first.
written: list[str] = []


def delete_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written since ``since`` of them were there, but for the last ``keep``.

    For callers that know that no frame still reads them.
    """
    stop = len(written) - keep
    for path in written[since:stop]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del written[since:stop]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage so that a lost executor repeats only what follows, and gives
    Catalyst the true size of small tables, by which it decides on broadcasts.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, columns: dict[str, pa.DataType], rows: Sequence[tuple]) -> DataFrame:
    """Rows of the driver as a table whose size Spark knows, and by which it decides on broadcasts."""
    values = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in columns]
    arrays = [pa.array(v, t) for v, t in zip(values, columns.values(), strict=True)]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null, empty or blank texts."""
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>")
    )


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.size(words(text)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fresh(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores in front as keep it apart from ``columns``."""
    while name in columns:
        name = f"_{name}"
    return name
