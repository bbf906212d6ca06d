"""Removal of repeated byte strings by depth-limited radix sort of suffixes.

Method: two suffixes matter to each other only if their first THRESHOLD bytes are equal, so they are dealt into groups
only that deep, by most-significant-digit passes that drop a suffix as soon as it is alone. The groups
left at full depth are exactly the repeated windows. A pass groups by shuffle and counts map-side, so no group
has to fit into a task; rows carry locators and digests, never text; all sizes take the same way.

1. The first digit is one that every window carries and that needs few rows: its anchor, the GRAM bytes
   of least hash in the window (leftmost on ties). Equal windows have equal anchors at equal
   distances. Consecutive windows share their anchor, so a document gives a run of windows for
   about every 80 bytes. Runs whose anchor occurs once are alone and go.
2. Runs that are equal as a whole are repeated, window by window, however many there are; one of them stays to
   stand for the others.
3. What is left are different runs of one anchor, at the edges of repeated passages. The further digits are the bytes
   around the anchor. A pass cuts a run into pieces by the distance from window to anchor, WIDTHS[k] distances each, so that all
   windows of a piece hold the same THRESHOLD - WIDTHS[k] + 1 bytes; these are its digit. Pieces alone with their digit go, pieces that are equal as a
   whole are repeated and leave one of them, the rest goes on. At the last pass a piece is one window, and its
   digit is all of its bytes.

Digits, runs and windows are told apart by 128 bits of BLAKE2b over their bytes; anchors by 64 bits of another hash, which only
deal rows out and never decide on equality.

Defined results: a null text counts as empty; texts under THRESHOLD bytes lose nothing. Rows that repeat id and text are occurrences
of their own, so all of them lose what they share. Rows of one id, null ids too, keep apart by a 64-bit hash of their texts. Very long texts are worked on in parts of PART bytes. Extra
columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dramatis.llm.common import ID, TEXT, Scratch, table

THRESHOLD, GRAM = 200, 40
#: Bytes of a text that are worked on at once; windows that cross are in the next part as well.
PART = 1 << 20
#: Distances from window to anchor that a piece spans, pass by pass; each divides the one before.
WIDTHS = (36, 6, 1)
#: Documents that may be named in a broadcast; beyond, their texts are joined by a shuffle. At 16 bytes each: 5 MB.
BROADCAST_DOCS = 300_000
FACTOR = 0x9E3779B97F4A7C15
LOW = np.uint64(0xFFFFFFFF)


@cache
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of FACTOR and of its inverse modulo 2**64, and a random number for each byte."""
    n = PART + THRESHOLD
    inverse = pow(FACTOR, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (np.uint64(FACTOR), np.uint64(inverse)))
    return up, down, np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive numbers."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, 1).ravel()
    to_right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(to_right[: n - width + 1], from_left[width - 1 : n])


def digests(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each part, in two longs."""
    both = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def runs_of(text: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of one part: for each run the first window, number of windows, offset of its anchor, hash of the anchor, digest of all its bytes.

    The bytes fix the windows and the place of the anchor, so equal digests mean runs that are equal in all this.
    """
    up, down, number = powers()
    sums = np.concatenate([[np.uint64(0)], np.cumsum(number[text] * up[: len(text)])])
    n = len(text) - gram + 1
    grams = mixed((sums[gram:] - sums[:n]) * down[:n])
    least = sliding_least(grams & ~LOW | np.arange(n, dtype=np.uint64), threshold - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    count = np.diff(np.concatenate([first, [len(least)]]))
    at = (least[first] & LOW).astype(np.int64)
    held = memoryview(text)
    whole = digests([held[a:b] for a, b in zip(first.tolist(), (first + count - 1 + threshold).tolist(), strict=True)])
    return first, count, at - first, grams[at].view(np.int64), *whole


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, a hash of the text (equal rows may share the pair), and the text."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")


RUN = "doc_id long, text_key long, first int, count int, offset int, anchor long, run long, run_low long"


def all_runs(docs: DataFrame, threshold: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            owners, sizes = [], []
            for k, text in enumerate(batch.column(2)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for at in range(0, len(data) - threshold + 1, PART):
                    found = runs_of(data[at : at + PART + threshold - 1], threshold, gram)
                    rows.append((found[0] + at, *found[1:]))
                    owners.append(k)
                    sizes.append(len(found[0]))
            if not rows:
                continue
            owner = np.repeat(owners, sizes)
            first, count, offset, anchor, whole, low = (np.concatenate(x) for x in zip(*rows, strict=True))
            owner = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(anchor), pa.array(whole), pa.array(low)], ["doc_id", "text_key", "first", "count", "offset", "anchor", "run", "run_low"])

    return docs.mapInArrow(run, RUN)


PIECE = "cell int, digit long, digit_low long, own long, own_low long, whole boolean, doc_id long, text_key long, first int, inner int, n int"


def pieces_of_runs(threshold: int, gram: int, wider: int | None, width: int):
    """From runs with their contents and ``cells`` (cell, whole), the pieces of ``wider`` distances that are left of them (None: a piece is the run): pieces of ``width`` distances."""
    reach = threshold - gram  # the largest distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, cell, inner, sizes, flags, keys, own = [], [], [], [], [], [], []
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("count", "offset", "content", "cells"))
            for k, (count, offset, content, cells) in enumerate(zip(*columns, strict=True)):
                least = offset - count + 1
                for part in cells:
                    low, high = (part["cell"], min(part["cell"] + wider - 1, offset)) if wider else (0, offset)
                    for at in range(max(low, least // width * width), high + 1, width):
                        top, bottom, last = min(at + width - 1, high), max(at, least), min(at + width - 1, reach)
                        if top < bottom:
                            continue
                        owner.append(k)
                        cell.append(at)
                        inner.append(offset - top)
                        sizes.append(top - bottom + 1)
                        flags.append(part["whole"])
                        keys.append(content[offset - at : offset + gram + reach - last])
                        own.append(content[offset - top : offset - bottom + threshold])
            of = pa.array(owner, pa.int32())
            found = [pa.array(cell, pa.int32()), *(pa.array(x) for x in (*digests(keys), *digests(own))), pa.array(flags, pa.bool_())]
            found += [batch.column(batch.schema.get_field_index(c)).take(of) for c in ("doc_id", "text_key", "first")]
            yield pa.RecordBatch.from_arrays([*found, pa.array(inner, pa.int32()), pa.array(sizes, pa.int32())], [c.split()[0] for c in PIECE.split(", ")])

    return run


def same_run(names: dict[str, str]):
    """The condition that ``names`` (of this side: of the other) locate the same text or run; ids may be null."""
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) if a == "doc_id" else F.col(a) == F.col(b) for a, b in names.items()])


def once(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of those that repeat id and text; only such rows are shuffled."""
    met = docs.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = scratch.keep(met.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")), "again")
    if again.isEmpty():
        return docs
    same = same_run({"doc_id": "id", "text_key": "key"})
    return docs.join(again, same, "left_anti").unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text_key"]))


def contents(docs: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """``wanted`` runs with the bytes that their windows cover, each once."""
    named = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "count", "offset", "whole")).alias("runs"))
    held = docs.join(named.withColumnsRenamed({"doc_id": "id", "text_key": "key"}), same_run({"doc_id": "id", "text_key": "key"}))
    one = held.select("doc_id", "text_key", "text", F.explode("runs").alias("r"))
    return one.select("doc_id", "text_key", "r.*", F.substring(F.col("text"), F.col("r.first") + 1, F.col("r.count") + threshold - 1).alias("content"))


def repeated_spans(docs: DataFrame, scratch: Scratch, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """Spans (doc_id, text_key, a, b) that cover all repeated windows of ``docs`` (doc_id, text_key, text), and nothing else."""
    runs = scratch.keep(all_runs(docs, threshold, gram), "runs")
    differs = F.expr("min(run) != max(run) or min(run_low) != max(run_low)")
    anchors = scratch.keep(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), differs.alias("several")).where("n > 1").select("anchor", "several"), "anchors")
    repeated = scratch.keep(runs.join(anchors, "anchor"), "repeated")
    scratch.drop("runs", "anchors")
    span = lambda df: df.select("doc_id", "text_key", F.col("first").alias("a"), (F.col("first") + F.col("count") - 1 + threshold).alias("b"))

    several, run = repeated.where("several"), ["anchor", "run", "run_low"]
    locators = [F.first(c).alias(c) for c in ("doc_id", "text_key", "first", "count", "offset")]
    distinct = scratch.keep(several.groupBy(*run).agg((F.count(F.lit(1)) > 1).alias("whole"), *locators), "distinct")
    found = span(repeated.where("not several")).unionByName(span(several.join(distinct.where("whole").select(*run), run)))

    ids = distinct.select("doc_id", "text_key").distinct()
    few = ids.count() <= BROADCAST_DOCS
    ids = ids.withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    some = docs.join(F.broadcast(ids) if few else ids, same_run({"doc_id": "id", "text_key": "key"}), "left_semi")
    fetched = scratch.keep(contents(once(some, scratch), distinct, threshold), "fetched")
    rows = fetched.select("*", F.array(F.struct(F.lit(0).alias("cell"), "whole")).alias("cells"))
    wider = None
    for k, width in enumerate(WIDTHS):
        pieces = scratch.keep(rows.mapInArrow(pieces_of_runs(threshold, gram, wider, width), PIECE), f"pieces{k}")
        digit, own = ["cell", "digit", "digit_low"], ["own", "own_low"]
        locators = [F.first(c).alias(c) for c in ("doc_id", "text_key", "first")]
        met = scratch.keep(pieces.groupBy(*digit, *own).agg(F.expr("count(1) > 1 or max(whole)").alias("whole"), *locators), f"met{k}")
        again = pieces.where("not whole").join(met.where("whole").select("cell", *own), ["cell", *own])
        found = found.unionByName(again.select("doc_id", "text_key", (F.col("first") + F.col("inner")).alias("a"), (F.col("first") + F.col("inner") + F.col("n") - 1 + threshold).alias("b")))
        if width == 1:
            return found
        # Pieces that share their digit with others go on, unless all of them are repeated anyway.
        open_ = met.groupBy(*digit).agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("all")).where("n > 1 and not all").select(*digit)
        left = met.join(open_, digit).groupBy("doc_id", "text_key", "first").agg(F.collect_list(F.struct("cell", "whole")).alias("cells"))
        names = {"doc_id": "id", "text_key": "key", "first": "at"}
        rows = fetched.join(left.withColumnsRenamed(names), same_run(names)).select(*fetched.columns, "cells")
        wider = width
    raise AssertionError("the last width is 1")


def cut(text: bytes, found: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is kept)."""
    if not len(found):
        return 0, 0, text
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, found[:, 0], 1)
    np.add.at(change, found[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    starts = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return int(gone.sum()), starts, np.frombuffer(text, np.uint8)[~gone].tobytes()


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = keyed(docs, id_col, text_col)
    found = repeated_spans(texts, scratch, threshold, gram)
    of_doc = scratch.keep(found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py()
                ab = np.stack([own.values.field(0).to_numpy(), own.values.field(1).to_numpy()], 1) if own.is_valid else np.zeros((0, 2), np.int64)
                gone, n, rest = cut(data, ab)
                for column, value in zip((sizes, removed, counts, kept), (len(data), gone, n, rest), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    own = of_doc.withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    joined = texts.join(own, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
