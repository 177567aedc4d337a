"""What the operators of this folder share: scratch tables, hot keys, row keys, word rules.

A *word* is a maximal run of characters outside U+0020 and U+0009-U+000D.

Scratch tables lie in the shared folder that spark.checkpoint.dir names. Those that an operator is done with go at once;
those that its lazy result still reads go when `passing` ends, or else when the application does.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
LEAST_ID = -(2**63)
#: Keys of over SHARE rows are split into parts of about as many; of these keys the HOT most frequent are (a broadcast of so
#: many rows), so any other has SHARE rows or one in HOT of all rows at most.
HOT, SHARE = 1000, 2000
#: Rows of a few numbers that are broadcast; a table of more is shuffled.
FEW = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where that is unset a local master (tests) gets a
    folder of its own; a cluster's executors would not see one another's files, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='scrivener-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_PASSING: list[list[Written]] = []
#: Spark's own switch: the shuffle files of an execution go when it ends, in place of when the driver collects its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Holds CLEANUP on; a plan that ran inside and runs again makes its shuffles anew."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Written:
    """A table written to the shared folder: its lineage ends there, so a lost executor costs a read only, and the shuffles
    that made it go at once."""

    def __init__(self, df: DataFrame, name: str, lasting: bool = False):
        self.spark = df.sparkSession
        self.path = f"{scratch(self.spark)}/scrivener-{uuid.uuid4().hex}-{name}"
        with _shuffles_go(self.spark):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        files, place = _place(self.spark, self.path)
        files.deleteOnExit(place)
        if _PASSING and not lasting:
            _PASSING[-1].append(self)

    def drop(self) -> None:
        files, place = _place(self.spark, self.path)
        files.delete(place, True)
        files.cancelDeleteOnExit(place)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df


@contextmanager
def passing() -> Iterator[None]:
    """Tables that are written inside, but for lasting ones, go when it ends: what reads them must be written by then."""
    _PASSING.append([])
    try:
        yield
    finally:
        for table_ in _PASSING.pop():
            table_.drop()


def few(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it is small; its size is counted."""
    return F.broadcast(df) if df.count() <= FEW else df


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """(_hot, _parts) of the keys to be split; counts has key and n, its number of rows."""
    most = counts.filter(F.col("n") > F.lit(SHARE)).orderBy(F.desc("n"), key).limit(HOT)
    return F.broadcast(most.select(F.col(key).alias("_hot"), F.ceil(F.col("n") / F.lit(max(SHARE, 1))).cast("int").alias("_parts")))


def dealt(df: DataFrame, hot: DataFrame, key: str, by: Column | None = None) -> DataFrame:
    """df with the column salt: the part of its key that a row belongs to (a hash `by` deals it), or else a row for each part."""
    parts = F.coalesce("_parts", F.lit(1))
    salt = F.explode(F.sequence(F.lit(0), parts - 1)) if by is None else F.pmod(by, parts.cast("bigint")).cast("int")
    return df.join(hot, F.col(key) == F.col("_hot"), "left").select(*(F.col(f"`{c}`") for c in df.columns), salt.alias("salt"))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """Whole text; null counts as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def id_of(docs: DataFrame, column: str = "doc_id") -> Column:
    return docs[column].cast("bigint")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """_id, _key, _text: a null id sorts before all others; rows that agree in id and text share the key."""
    t = text_of(docs, text)
    return [F.coalesce(id_of(docs, doc_id), F.lit(LEAST_ID)).alias("_id"), F.xxhash64(t).alias("_key"), t.alias("_text")]


def packed(docs: DataFrame, *without: str) -> Column:
    """All columns but those in one struct _row, so that their names can't meet those of an operator."""
    kept = [c for c in docs.columns if c not in without]
    return (F.struct(*(docs[f"`{c}`"] for c in kept)) if kept else F.lit(None)).alias("_row")


def real_id(column: str = "_id") -> Column:
    """Undoes the stand-in for a null id."""
    return F.when(F.col(column) != F.lit(LEAST_ID), F.col(column))


def sql_lower(column: str) -> str:
    """DuckDB: A-Z only, as the kernels do."""
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
