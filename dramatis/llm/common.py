"""What the operators share: scratch tables on shared storage, table reading, row batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Column names of the corpus tables.
ID, TEXT = "doc_id", "text"
#: Ids that may be broadcast, a few MB; beyond, rows are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Bytes of an Arrow batch: texts are long, and each Python worker holds a batch several times over.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Of a sample of n, so many times n rows are drawn by hash before the n of least hash are taken.
OVERSAMPLING, DRAW = 3, 1_000_003


def text_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches in this session, unless it has a bound of its own (the default is in plain bytes)."""
    held = spark.conf.get(BATCH_SETTING).rstrip("bB")
    if held.isdigit() and int(held) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return what Arrow and the allocator hold but do not use: a worker lives on, idle or in other stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(array: pa.Array, rows: int = 512) -> Iterator[list]:
    """The values of an Arrow array some rows at a time, so that not all of a batch are Python objects at once."""
    for at in range(0, len(array), rows):
        yield array.slice(at, rows).to_pylist()
    give_back()


def mapped(array: pa.Array, of: Callable, kind: pa.DataType) -> pa.Array:
    """``of`` applied to each value."""
    parts = [pa.array([of(x) for x in part], kind) for part in slices(array)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or what no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all executors are threads of the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="dramatis-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Tables written to shared storage to cut lineage; a lost executor costs a re-read, not a recomputation.

    ``keep`` writes a frame and returns it as read back; ``drop`` deletes tables no longer needed.
    Tables that a returned lazy frame still reads stay until the folder is cleaned by its owner.
    """

    def __init__(self, spark: SparkSession, name: str):
        text_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def only_kept(docs: DataFrame, id_col: str, decisions: DataFrame, key: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that stay by ``decisions``, with all their columns.

    ``decisions`` are (id, kept), and rows that share an id stay if any of them does; or, with ``key``, a column over
    ``docs`` that tells texts apart, (id, kept, group, key): then of the kept rows of one id and group one stays, of the least key.
    ``key`` is computed only for rows of ids that repeat.
    """
    name, key_name = fresh_name(docs, "dropped_id"), fresh_name(docs, "kept_key")
    scratch = Scratch(docs.sparkSession, "dropped")
    same_id = F.col(id_col).cast("long").eqNullSafe(F.col(name))
    decisions = decisions.toDF("id", "kept", *(["group", "key"] if key is not None else []))
    by_id = decisions.groupBy("id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    told = scratch.keep(by_id.where(F.expr("not kept") if key is None else F.expr("not kept or n > 1")).select(F.col("id").alias(name), "kept"), "ids")
    spread = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    out = docs.join(spread(told.select(name)), same_id, "left_anti")
    mixed = told.where("kept").select(name)
    if key is None or mixed.isEmpty():
        return out
    repeated = decisions.where("kept").join(spread(mixed), F.col("id").eqNullSafe(F.col(name)), "left_semi")
    staying = scratch.keep(repeated.groupBy("id", "group").agg(F.min("key").alias(key_name)).select(F.col("id").alias(name), key_name), "staying")
    keyed = docs.join(spread(mixed), same_id, "left_semi").withColumn(fresh_name(docs, "own_key"), key)
    own = F.col(fresh_name(docs, "own_key"))
    again = keyed.join(staying, same_id & own.eqNullSafe(F.col(key_name)))
    first = F.row_number().over(Window.partitionBy(name, key_name).orderBy(F.lit(1)))
    rank = fresh_name(docs, "row_rank")
    return out.unionByName(again.withColumn(rank, first).where(F.col(rank) == 1).select(*docs.columns))


def drawn(rows: Column, wanted: int, total: Column) -> Column:
    """Whether a row is drawn, by the hash of ``rows``, into the superset of a sample of ``wanted`` out of ``total``. So no task has to rank more than that."""
    return F.pmod(F.xxhash64(rows, F.lit("draw")), F.lit(DRAW)) * total <= F.lit(OVERSAMPLING * wanted * DRAW)
