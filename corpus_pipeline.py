"""From documents to token files: quality rules, near copies, benchmark leaks, mixing, token ids.

Each stage takes all that the one before kept, written as Parquet and read again, so a lost
executor or a restart costs one stage at most.  Null languages and sources are values like others,
null texts have no words and fail the first stage.  Of rows that share an id one stays; rows
without id stay unless their text goes.  An empty table gives an empty result; further columns,
whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import decontaminate, group_join, mixing, rules, token_files
from tillwise.sources.shared import release, shared_folder, stored_tables


#: Bytes of rows that a stage hands to a Python worker at a time.  Spark's own bound, 64 MB, is held
#: several times over outside the heap: by the writer, the worker and the reader of each task.
BATCH_BYTES = 4 * 1024 * 1024

_tables: dict[str, list[str]] = {}


def _stage(work: Callable) -> Callable:
    """A stage that first removes what the stage before has stored for itself.

    The result of that one must be written by then, as ``run`` does.  The session's Arrow batches
    are bounded by ``BATCH_BYTES`` from then on, as the result is read after the stage returns.
    """

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.conf.get("spark.app.id", "local")
        release(spark, _tables.pop(app, []))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
        before = set(stored_tables(spark))
        result = work(spark, docs, sf_dir)
        _tables[app] = [t for t in stored_tables(spark) if t not in before]
        return result

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier rule keep."""
    return rules.clean(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, a similarity of 0.8."""
    return group_join.representatives(docs, size=5, per_cent=80)


@_stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the curriculum takes, once per copy, in training order."""
    return mixing.mix(docs)


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each row's ids, as read back from the token files.

    The files keep the training order, which is that of the stored rows of the stage before.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    order = [part, F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    return token_files.digests(docs, order=order, keep_words=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("mixed_sources", mixed_sources),
    ("token_ids", token_ids),
]

#: Robust estimates and token ids are not expressible in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
