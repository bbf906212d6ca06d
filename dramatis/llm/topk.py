"""Exact top-k inner-product search by multi-resolution segment statistics.

Method: a vector is cut into segments, and of each segment the mean and the deviation (norm around the mean)
are kept, at several resolutions. For a query and a candidate, the product over a segment of length L
is at most L * mean * mean + deviation * deviation, which is the lower bound on the distance
turned into an upper bound on the inner product. Bounds are taken from coarse to fine; pairs whose
bound is under the tenth score found so far go, and exact products are computed for survivors.

Queries are a stated set, which grows with the table, so they are read in blocks of fixed size: each block is
broadcast (at most BLOCK_BYTES) and meets all rows once. Each task keeps k rows per query, so that what is
shuffled for the final ranking is k rows per query and task.

Integer products are exact: in float64 while dimension * largest component squared stays below 2**53, in
64-bit integers beyond it.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part. Nor do vectors whose
length differs from the query's. Rows that repeat a vec_id are candidates of their own, except
for queries of that id. Where query rows repeat a vec_id, each distinct vector of it is searched once, and the k best of
all their pairs are the id's, as in the SQL; a candidate may be there once for each. Rows of null vec_id neither ask nor
are candidates. Fewer rows than k give all. An empty table gives an empty result.
Components must keep products within a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramatis.llm.common import Scratch, table

K, SCALE, EVERY = 10, 1024, 100
#: Segments at each resolution, and bytes of query vectors that are broadcast at once.
RESOLUTIONS, BLOCK_BYTES = (1, 4, 16), 8 << 20
#: Candidates that are compared at once.
CHUNK = 2048


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows (sqrt(L) * mean, deviation) per segment: the bound on a product is the product of two such rows."""
    parts = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        mean = part.mean(1, keepdims=True)
        parts += [mean * np.sqrt(part.shape[1]), np.sqrt(np.square(part - mean).sum(1, keepdims=True))]
    return np.concatenate(parts, 1)


class Block:
    """A block of queries of one dimension, with the best rows found for each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k, self.x = ids, k, vectors.astype(np.float64)
        self.exact_limit = np.abs(self.x).max(initial=0)
        self.stats = [statistics(self.x, s) for s in RESOLUTIONS if s < self.x.shape[1]]
        self.floor = np.full(len(ids), -np.inf)
        self.query, self.row, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        if not len(ids):
            return
        pair_q, pair_y = np.meshgrid(np.arange(len(self.ids)), np.arange(len(ids)), indexing="ij") if not self.stats else (None, None)
        for level, segments in enumerate(s for s in RESOLUTIONS if s < self.x.shape[1]):
            of_y = statistics(y, segments)
            if level == 0:
                bound = self.stats[0] @ of_y.T
                pair_q, pair_y = np.nonzero(self.reach(bound) >= self.floor[:, None])
            elif len(pair_q):
                bound = np.einsum("ij,ij->i", self.stats[level][pair_q], of_y[pair_y]) if len(pair_q) * 8 < len(self.ids) * len(ids) else (self.stats[level] @ of_y.T)[pair_q, pair_y]
                near = self.reach(bound) >= self.floor[pair_q]
                pair_q, pair_y = pair_q[near], pair_y[near]
        pair_q, pair_y = pair_q.ravel(), pair_y.ravel()
        other = self.ids[pair_q] != ids[pair_y]
        pair_q, pair_y = pair_q[other], pair_y[other]
        score = self.exact(pair_q, pair_y, y)
        self.keep(pair_q, ids[pair_y], score)

    @staticmethod
    def reach(bound: np.ndarray) -> np.ndarray:
        """The bound with room for rounding."""
        return bound + np.abs(bound) * 1e-9 + 1e-6

    def exact(self, q: np.ndarray, p: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.exact_limit * np.abs(y).max(initial=0) * y.shape[1] < 2.0**53:
            many = len(q) * 8 >= len(self.ids) * len(y)
            return ((self.x @ y.T)[q, p] if many else np.einsum("ij,ij->i", self.x[q], y[p])).astype(np.int64)
        return np.einsum("ij,ij->i", self.x.astype(np.int64)[q], y.astype(np.int64)[p])

    def keep(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        ok = score >= self.floor[query]
        query, row, score = (np.concatenate(x) for x in ((self.query, query[ok]), (self.row, row[ok]), (self.score, score[ok])))
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.searchsorted(query, np.arange(len(self.ids)))
        rank = np.arange(len(query)) - first[query]
        tenth = rank == self.k - 1
        self.floor[query[tenth]] = score[tenth]
        best = rank < self.k
        self.query, self.row, self.score = query[best], row[best], score[best]


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and the vector as whole doubles; rows that take no part are gone."""
    as_double = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(as_double, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def best_rows(vectors: DataFrame, block: list, k: int) -> DataFrame:
    """The k best rows per query and task."""
    queries = [(r.vec_id, r.v) for r in block]
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list] = {}
        for vec_id, v in shared.value:
            by_size.setdefault(len(v), []).append((vec_id, v))
        blocks = {n: Block(np.array([i for i, _ in qs]), np.array([v for _, v in qs]).reshape(len(qs), n), k) for n, qs in by_size.items()}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            starts = lists.offsets.to_numpy()[:-1]
            flat = lists.values.to_numpy(zero_copy_only=False)
            for n, found in blocks.items():
                rows = np.flatnonzero(sizes == n)
                for at in range(0, len(rows), CHUNK):
                    some = rows[at : at + CHUNK]
                    found.meet(ids[some], flat[starts[some][:, None] + np.arange(n)])
        for found in blocks.values():
            yield pa.RecordBatch.from_arrays([pa.array(found.ids[found.query]), pa.array(found.row), pa.array(found.score)], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer product for each query, ties to the smaller id."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    asked = scratch.keep(integer_vectors(queries, id_col, vector_col, scale).where("vec_id is not null").dropDuplicates(["vec_id", "v"]), "queries")
    total = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 64), F.lit(0)).alias("bytes")).first().bytes
    blocks = max(1, -(-2 * int(total) // block_bytes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    found: DataFrame | None = None
    for b in range(blocks):
        block = asked.where(F.col("block") == b).drop("block").collect()  # about half of block_bytes
        part = best_rows(vectors.where("vec_id is not null"), block, k)
        if blocks > 1:
            part = scratch.keep(part, f"best{b}")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
