"""Lineage cuts in shared storage, and sizes read from the plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks that part words; every other code point belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only on a local master (tests) one is made where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="lagwise-")
            spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: the lineage ends there.

    A lost executor then costs a re-read, not a re-computation, and later plans see exact sizes.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that `cut` wrote and that nothing reads again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files; else they stay until the driver's collector finds them unused."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def stable(df: DataFrame, label: str) -> DataFrame:
    """df itself if it is a plain read of a table, which comes in the same order every time; else a cut of it.

    Operators that read their input more than once and match blocks of it need this.
    """
    plain, todo = {"Project", "Filter", "LogicalRelation", "LocalRelation"}, [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in plain:
            return cut(df, label)
        below = node.children()
        todo += [below.apply(k) for k in range(below.size())]
    return df


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df's sources, for sizing buckets. Never decides what is kept."""
    total = 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for k in range(leaves.size()):
        total += int(str(leaves.apply(k).stats().sizeInBytes()))
    return min(total, 1 << 60)


def text_size(df: DataFrame, expand: int = 4) -> int:
    """A guess at df's bytes once decompressed; only steers how an exchange is dealt, never what is kept."""
    return plan_bytes(df) * expand


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of text in order; null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * 5), " "), "")


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n
