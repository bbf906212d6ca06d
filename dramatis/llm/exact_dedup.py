"""Exact dedup as a stateful stream with disk-backed keyed state.

Method: digests of the normalised texts (A-Z lower-cased, UTF-8) flow through a streaming
aggregation whose state lives in RocksDB and never expires. Per digest the state retains the
digest, a stable identifier (the largest id so far), and a content locator (the file that
holds that row). What the stream marks as a hit is then checked on full bytes: the texts of
all digests seen more than once are fetched by identifier and locator, and the smallest and
the largest byte string of a digest must be equal. Map-side combining holds at most two texts
of a digest per task, however many copies there are. Where they differ (a digest collision),
those documents are grouped again by their whole text.

Defined results: a null text counts as empty. A row is a document; rows that repeat an id
share the decision, so ``kept`` is true for each row that has the id that stays. A null id
never wins against another one. An empty table gives an empty result. Extra columns are kept by
``kept_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from dramatis.llm.common import ID, TEXT, Scratch, mapped, only_kept, table

#: State of the stream is kept in RocksDB on local disk and uploaded to the checkpoint.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Input of one trigger, and keys that a partition of the state is planned for (each has a RocksDB instance, which takes some MB of disk at least).
FILES_PER_TRIGGER, KEYS_PER_STATE, LEAST_STATES = 4096, 50_000, 12
STATES = "spark.sql.streaming.internal.stateStore.partitions"
#: Hits that may be broadcast; beyond, the texts are joined by a shuffle. At about 100 bytes each: 20 MB.
BROADCAST_HITS = 200_000


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


@F.arrow_udf(BinaryType())
def normalised(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes with A-Z lower-cased and nothing else."""
    return mapped(texts.cast(pa.binary()), lambda t: (t or b"").lower(), pa.binary())


def digest_udf(digest: Callable[[bytes], bytes]):
    @F.arrow_udf(BinaryType())
    def of(texts: pa.Array) -> pa.Array:
        return mapped(texts.cast(pa.binary()), lambda t: digest((t or b"").lower()), pa.binary())

    return of


def stream_state(scratch: Scratch, keys: DataFrame, path: str, files_per_trigger: int) -> DataFrame:
    """Run the stream over the table ``keys`` at ``path`` to its end; the final state, one row a digest."""
    spark = scratch.spark
    conf = ROCKSDB | {STATES: str(max(LEAST_STATES, -(-keys.count() // KEYS_PER_STATE)))}
    before = {k: spark.conf.get(k) if spark.conf._jconf.contains(k) else None for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        updates = (
            spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
            .groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        )
        # A repeated batch overwrites its own folder, so a restart counts nothing twice.
        write = lambda df, batch: df.write.mode("overwrite").parquet(f"{scratch.path('updates')}/batch={batch}")
        updates.writeStream.outputMode("update").option("checkpointLocation", scratch.path("stream")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
        state = spark.read.schema("digest binary, best struct<doc_id: long, locator: string>, group_size long, batch int").parquet(scratch.path("updates")) if _exists(scratch, "updates") else None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if state is None:
        return spark.createDataFrame([], "digest binary, best struct<doc_id: long, locator: string>, group_size long")
    # The identifier and the size only ever grow, so the last update of a digest holds its largest values.
    return state.groupBy("digest").agg(F.max("best").alias("best"), F.max("group_size").alias("group_size"))


def _exists(scratch: Scratch, name: str) -> bool:
    where = scratch.spark._jvm.org.apache.hadoop.fs.Path(scratch.path(name))
    return where.getFileSystem(scratch.spark._jsc.hadoopConfiguration()).exists(where)


def exact_groups(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, digest: Callable[[bytes], bytes] = sha256, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (the digest in hex)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    digest_of = digest_udf(digest)
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    try:
        source = docs.select(*columns, F.input_file_name().alias("locator"))
    except AnalysisException:  # rows of several tables have no file of their own; then the identifier alone locates
        source = docs.select(*columns, F.lit("").alias("locator"))
    keys = scratch.keep(source.select("doc_id", "locator", digest_of("text").alias("digest")), "keys")
    groups = scratch.keep(stream_state(scratch, keys, scratch.path("keys"), files_per_trigger), "groups")
    scratch.drop("stream", "updates")
    labelled = scratch.keep(keys.join(groups, "digest").select("digest", "doc_id", "locator", F.col("best.doc_id").alias("keep_id"), "group_size"), "labelled")
    scratch.drop("keys", "groups")

    hits = labelled.where("group_size > 1").select("doc_id", "locator")
    few = hits.count() <= BROADCAST_HITS
    named = hits.distinct().select(F.col("doc_id").alias("hit_id"), F.col("locator").alias("hit_at"))
    held = source.join(F.broadcast(named) if few else named, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("locator") == F.col("hit_at")), "left_semi")
    texts = held.select("doc_id", normalised("text").alias("content"), digest_of("text").alias("digest"))
    bounds = texts.groupBy("digest").agg(F.min("content").alias("least"), F.max("content").alias("most"))
    collided = scratch.keep(bounds.where("least <> most").select("digest"), "collided")
    result = labelled.select("digest", "doc_id", "keep_id", "group_size")
    if not collided.isEmpty():
        again = texts.join(collided, "digest")
        by_text = again.groupBy("digest", "content").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        alone = source.select("doc_id", normalised("text").alias("content"), digest_of("text").alias("digest")).join(collided, "digest", "left_semi")
        result = result.join(collided, "digest", "left_anti").unionByName(alone.join(by_text, ["digest", "content"]).select("digest", "doc_id", "keep_id", "group_size"))
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """The documents that stay, with all their columns; of rows equal in id and text, one."""
    digest = F.unhex("text_sha256")
    return only_kept(docs, id_col, exact_groups(docs, id_col, text_col).select("doc_id", "kept", digest, digest), digest_udf(sha256)(F.col(text_col)))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
