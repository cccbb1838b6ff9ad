"""Intermediate tables in the folder every executor can reach.

A frame that is read more than once, or that may be broadcast, is written there first.  That
does three things: it is computed once, losing an executor costs no recomputation, and the
planner sees its true size, so it is broadcast only within a known bound and shuffled beyond.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode.

    A folder with the scheme ``file`` is taken as named: it may be a mount that all share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="tillwise-")
        atexit.register(shutil.rmtree, _own_folder[app], ignore_errors=True)
    return _own_folder[app]


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table."""
    spark = df.sparkSession
    app = spark.conf.get("spark.app.id", "local")
    path = f"{shared_folder(spark)}/tillwise/{app}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(app, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_tables(spark: SparkSession) -> list[str]:
    """The folders of the tables that this session has stored, in order."""
    return list(_written.get(spark.conf.get("spark.app.id", "local"), []))


def release(spark: SparkSession, only: Iterable[str] | None = None) -> int:
    """Remove the tables that this session has stored, and nothing else; return their number.

    Call it when the results that were built on them have been read or written.  ``only`` names
    some of ``stored_tables``.
    """
    app = spark.conf.get("spark.app.id", "local")
    chosen = set(_written.get(app, []) if only is None else only)
    paths = [p for p in _written.get(app, []) if p in chosen]
    _written[app] = [p for p in _written.get(app, []) if p not in chosen]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)


def _only_scans(plan) -> bool:
    """Is this a scan with at most filters and projections on top?"""
    while plan.children().size() == 1 and plan.nodeName() in ("Filter", "Project"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "LocalRelation")


def reusable(df: DataFrame) -> DataFrame:
    """A frame that will be read several times: stored, unless it is a stored table already."""
    return df if _only_scans(df._jdf.queryExecution().optimizedPlan()) else settle(df)


# Bounds under which a stored side is broadcast even above Spark's own threshold: the facts it
# spares from a shuffle are far larger.  Bytes are those of the rows as text, not of the file.
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 2_000_000


def _estimate(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _threshold(df: DataFrame) -> int:
    return df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def sized(df: DataFrame) -> DataFrame:
    """Make sure the planner can judge the size of ``df``, the small side of a join.

    Left alone when its upper estimate is already under the broadcast threshold.  Otherwise
    stored and measured: broadcast within the bounds above, and shuffled like any other table
    beyond them, or where broadcasting is switched off.
    """
    threshold = _threshold(df)
    if _estimate(df) <= threshold:
        return df
    stored = settle(df)
    size = _estimate(stored)
    if threshold < size <= BROADCAST_BYTES and threshold > 0:
        width = F.sum(F.length(F.to_json(F.struct("*"))) + 32)
        rows, memory = stored.agg(F.count("*"), width).first()
        if rows <= BROADCAST_ROWS and (memory or 0) <= BROADCAST_BYTES:
            return F.broadcast(stored)
    return stored
