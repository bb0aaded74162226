"""A training-corpus pipeline: documents in, encoded training texts out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import delete_written, materialize, table, written
from marlstone.llm.mixing import cut_mix
from marlstone.llm.pieces import sample_pieces
from marlstone.llm.quality import keep_good
from marlstone.llm.simhash import keep_one_of_each
from marlstone.llm.toxicity import drop_toxic

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", lambda spark, docs, sf_dir: keep_good(docs)),
    ("toxicity", lambda spark, docs, sf_dir: drop_toxic(docs, table(spark, sf_dir, "labels"))),
    ("simhash", lambda spark, docs, sf_dir: keep_one_of_each(docs)),
    ("mixing", lambda spark, docs, sf_dir: cut_mix(docs)),
    ("sentencepiece", lambda spark, docs, sf_dir: sample_pieces(docs)),
]

#: Learned filters and iterative groups are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again.

    A stage's output needs nothing that was written before it, which is then deleted. Rows are told apart by keys of their own, so null and repeated
    ids are documents like any others; texts that are null, empty or too short fail the base rules and go in the first stage; columns of any names are carried
    up to the last stage; no documents give no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), len(written)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        delete_written(spark, since=before, keep=1)
    return docs
