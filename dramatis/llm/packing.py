"""Best-fit packing of token pieces into sequences by large-item matching.

Method: pieces above one third of the capacity are large; a sequence holds at most two of them, and a greedy
matching, from the largest down, gives each the largest partner that still fits. Smaller pieces then go,
from the largest down, into the tightest gap that holds them, and into new sequences where none does.

Pieces of one length are interchangeable, so the plan is made over counts by length: at most CAPACITY
numbers, whatever the size of the corpus. It consists of runs: "of length s, those numbered
r to r + n go to the sequences from b on, m in each, at this offset". Pieces are then numbered by length in a distributed
way (cells of hashed ids, so that no length is a hot key) and looked up in the runs.

Defined results: a null text counts as empty and gives a piece of one id (the closing id 0), as does an empty text.
Rows that repeat an id are packed each for itself. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramatis.llm.bpe import id_bytes, texts_of, vocabulary
from dramatis.llm.common import ID, TEXT, Scratch, table

CAPACITY, CELLS, CLOSING = 2048, 256, 0
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """The pieces of each document: its ids and the closing id, cut only where longer than the capacity."""
    closing = CLOSING.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), id_bytes(path, texts_of(batch.column(1))), strict=True):
                ids += closing
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first number, how many, first sequence, how many in each, offset) from counts by length."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    left = {s: n for s, n in counts.items() if n}
    taken = dict.fromkeys(left, 0)
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, how many), sorted
    sequences = 0

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, taken[length], n, first, each, offset))
        taken[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            insort(gaps, (gap, first, n))

    # Large pieces: each with the largest that fits beside it.
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            n = left[a]
            put(a, n, sequences, 1, 0)
            leave(capacity - a, sequences, n)
            sequences += n
            large.pop()
            continue
        b = large[at]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if a == b:
            put(a, 2 * n, sequences, 2, 0)
        else:
            put(a, n, sequences, 1, 0)
            put(b, n, sequences, 1, a)
        leave(capacity - a - b, sequences, n)
        sequences += n
        if a == b and left[a]:  # an odd one: alone, or with the next smaller
            if len(large) > 1:
                c = large[-2] if at == len(large) - 1 else large[at]
                put(a, 1, sequences, 1, 0)
                put(c, 1, sequences, 1, a)
                leave(capacity - a - c, sequences, 1)
            else:
                put(a, 1, sequences, 1, 0)
                leave(capacity - a, sequences, 1)
            sequences += 1
        large = [s for s in large if left[s]]

    # Small pieces: the tightest gap first.
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(gaps, (s, -1, -1))
            if at == len(gaps):
                each = min(capacity // s, left[s])
                n = left[s] // each
                put(s, n * each, sequences, each, 0)
                leave(capacity - each * s, sequences, n)
                sequences += n
                continue
            gap, first, n = gaps.pop(at)
            each = min(gap // s, left[s])
            full = min(n, left[s] // each)
            put(s, full * each, first, each, capacity - gap)
            leave(gap - each * s, first, full)
            leave(gap, first + full, n - full)
    return runs


def place(numbered: DataFrame, runs: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """sequence_id and offset of pieces that carry their number within their length (``rank``)."""
    ordered = np.array(sorted(runs), np.int64).reshape(-1, 6)
    shared = numbered.sparkSession.sparkContext.broadcast(ordered)
    names = [c for c in numbered.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        keys = known[:, 0] << 44 | known[:, 1]
        for batch in batches:
            table_ = pa.Table.from_batches([batch])
            length, rank = table_.column("length").to_numpy(), table_.column("rank").to_numpy()
            own = known[np.searchsorted(keys, length << 44 | rank, "right") - 1] if batch.num_rows else known[:0]
            k = rank - own[:, 1]
            sequence, offset = own[:, 3] + k // np.maximum(own[:, 4], 1), own[:, 5] + k % np.maximum(own[:, 4], 1) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name in names)
    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, cells: int = CELLS, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, path, capacity, id_col, text_col).withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)).cast("int")), "pieces")
    by_length = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    counts = cut.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # at most capacity * cells rows
    within = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = cut.withColumn("k", within).join(offsets, ["length", "cell"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k") - 1).alias("rank"))
    return place(numbered, plan(by_length, capacity))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
