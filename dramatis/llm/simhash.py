"""SimHash near-dedup by covering locality-sensitive hashing.

Method: bit i of a fingerprint is given the vector v(i) = 1 + i mod (2**(r + 1) - 1), of r + 1 bits. For each of the
2**(r + 1) - 1 non-zero masks m, table m keeps the bits with odd parity of v(i) & m. At most r differing bits put
r linear conditions on r + 1 unknowns, so some m leaves all these bits out: every pair within radius r
collides in some table, for sure.

``near_groups`` links fingerprints of 64 bits within radius 2 (seven tables). The same construction is repeated over the bits that a table
leaves out wherever a bucket is large (37 bits are kept by a table, then about 52, then more),
so buckets stay bounded and no pair within the radius is lost. Fingerprints
are distinct before they are hashed, so copies never meet as pairs. Inside a bucket, links are found by vectorised comparison and reduced to a star per component; the
components over all buckets follow from least-label propagation with pointer jumping, each
round a table on shared storage.

``similar_groups`` links texts whose sets of word shingles have a Jaccard similarity of ``least`` or more. At 0.8 two SimHash fingerprints
differ in about 15 % of their bits, a radius that no few tables cover, so the fingerprint has BLOCKS blocks of BLOCK_BITS bits and each block is covered for
radius BLOCK_RADIUS: every pair within that radius in any block collides, so every pair with at most BLOCKS * (BLOCK_RADIUS + 1) - 1 differing bits does, and most pairs beyond it. Pairs of a
bucket are held against SKETCH_BITS further bits, then against all bits, and at last exactly by their sets: for each text of a bucket, the nearest one before it.
Buckets of more than about BUCKET texts are dealt out in cells that share some leaders. This links nearly all that is similar, but not all.

An exact pass then finds every pair that is left, so no link is lost whatever the fingerprints, filters and cells above left out. Two sets of the
similarity share a shingle among the first n - ceil(least * n) + 1 of each in any common order (shingles that a sample of texts holds often come last,
then by hash; the sample decides how much work there is, not what is found). Texts that share one and whose components still differ
are compared by size, by the place of the shingle, and by PARITY_BITS bits, each the parity of a share of the set's shingles: no more bits differ
than shingles do, so none of these bounds drops a similar pair. That many bits say little of sets of more than twice as many shingles, so their pairs are
compared by more parities next, half a bit or more a shingle (``undecided``). What passes is checked by the full sets, each of which is copied to all pairs that it is left in. Texts of one
component are not compared, so copies are not expanded into all pairs; what is not in the component of most of a shingle's texts is held against cells of about BUCKET texts.

Defined results: a null text counts as empty; texts without a word have fingerprint zero and link
like others (``similar_groups``: are one group). Texts of any length are read whole. Repeated rows share a fingerprint and a component. A null id never becomes a
component's id unless all its ids are null. Extra columns, whatever their names, are ignored, and kept by ``kept_documents``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramatis.llm.common import BROADCAST_IDS, ID, TEXT, Scratch, drawn, mapped, only_kept, table

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Distinct fingerprints of a bucket beyond which it is hashed further, and free bits below which it never is.
BUCKET, LEAST_FREE = 1000, 6
#: Names of large buckets that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_BUCKETS = 100_000
ONES = np.uint64(0x0101010101010101)

# Of ``similar_groups``.
WORDS, LEAST = 5, 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS, SKETCH_BITS = 7, 36, 3, 64
#: Differing bits of the sketch, and of all N_WORDS * 64 bits, beyond which a pair is left to the exact pass.
SKETCH_FAR, ALL_FAR = 17, 62
#: One text in so many is in the sample that finds large buckets; leaders that all cells of such a bucket share; and pairs that are sent on at once.
SAMPLED, LEADERS, CHUNK = 64, 8, 100_000
#: Bits of a set's parities; texts of which shingles are counted for the order of the exact pass, the least count there, and shingles that are broadcast (under 1 MB).
PARITY_BITS, ORDER_DOCS, ORDER_COUNT, ORDER_SHINGLES = 1024, 1500, 3, 50_000
#: Links of which a task makes a forest (16 MB with their nodes' numbers).
FOREST_LINKS = 500_000
#: Word hashes that are remembered within a batch.
REMEMBERED_WORDS = 100_000


def fingerprint(text: bytes) -> int:
    """64 majority bits of the XXH64 of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip((ends - lengths)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    runs = np.arange(0, len(hashes), 255)
    out = 0
    for k in range(8):  # eight counters of a byte at once, over runs too short to overflow
        counts = np.add.reduceat(hashes >> np.uint64(k) & ONES, runs).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        out |= sum(1 << (8 * byte + k) for byte in np.flatnonzero(counts * 2 > len(hashes)).tolist())
    return out


def fingerprints(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"") for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """Over the bits of ``free``, 2**(radius + 1) - 1 masks of which, for any ``radius`` bits, at least one holds none."""
    bits, n = [i for i in range(64) if free >> i & 1], (2 << radius) - 1
    return [sum(1 << bit for k, bit in enumerate(bits) if ((1 + k % n) & m).bit_count() & 1) for m in range(1, n + 1)]


def hash_tables(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (mask, key, fp) of all buckets, none of which holds more than BUCKET fingerprints."""
    everything = (1 << 64) - 1
    masks = covering_masks(everything)
    rows = _hashed(fps, {None: masks})
    done: DataFrame | None = None
    for level in range(8):
        counts = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET)
        free = {m: everything & ~m for m in masks}
        deeper = {m: [m | x for x in covering_masks(free[m])] for m in masks if free[m].bit_count() >= LEAST_FREE}
        large = scratch.keep(counts.select("mask", "key").where(F.col("mask").isin([signed(m) for m in deeper])), f"large{level}") if deeper else None
        if large is None or large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        named = F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large
        small = rows.join(named, ["mask", "key"], "left_anti")
        done = small if done is None else done.unionByName(small)
        present = {r[0] & everything for r in large.select("mask").distinct().collect()}  # at most 7 ** level masks
        rows = _hashed(rows.join(named, ["mask", "key"], "left_semi").select("mask", "fp"), {m: deeper[m] for m in present})
        masks = [x for m in present for x in deeper[m]]
    raise AssertionError("free bits run out before this")


def _hashed(rows: DataFrame, to: dict[int | None, list[int]]) -> DataFrame:
    """Each fingerprint under each mask that its present mask leads to."""
    if None in to:
        masks = F.array(*[F.lit(signed(m)).cast("long") for m in to[None]])
    else:
        masks = F.element_at(F.create_map(*[x for m, deeper in to.items() for x in (F.lit(signed(m)).cast("long"), F.array(*[F.lit(signed(d)).cast("long") for d in deeper]))]), F.col("mask"))
    return rows.select(F.explode(masks).alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 under links a-b: the least node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: a link (child, parent) from each fingerprint to the least of its component in the bucket."""
    held = np.zeros((0, 3), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        same = (rows[1:, :2] == rows[:-1, :2]).all(1)
        group = np.concatenate([[0], np.cumsum(~same)]) if len(rows) else np.zeros(0, np.int64)
        fp, left, right = rows[:, 2].view(np.uint64), [], []
        at = np.flatnonzero(same)
        lag = 1
        while len(at):
            close = np.bitwise_count(fp[at] ^ fp[at + lag]) <= RADIUS
            left.append(at[close])
            right.append(at[close] + lag)
            lag += 1
            at = at[at + lag < len(rows)]
            at = at[group[at] == group[at + lag]]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        label = least_labels(len(rows), a, b)
        child = np.flatnonzero(label != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(rows[child, 2]), pa.array(rows[label[child], 2])], ["a", "b"])

    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], 1)]) if batch.num_rows else held
        if not len(rows):
            continue
        last = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))[-1]) + 1 if (rows[:, :2] != rows[-1, :2]).any() else 0
        held = rows[last:]
        if last:
            yield links(rows[:last])
    yield links(held)


def forest(links: DataFrame, scratch: Scratch, name: str, most: int = FOREST_LINKS) -> DataFrame:
    """Links that connect the same nodes as ``links`` (a, b): of about ``most`` links a task, each node to the least of its component there.

    A text of a large group has a link in each of many buckets; so one is left of these where a task holds the group, and never more than there were.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([c.to_numpy() for c in batch.columns], 1) for batch in batches if batch.num_rows]
        if not parts:
            return
        nodes, at = np.unique(np.concatenate(parts), return_inverse=True)
        at = at.reshape(-1, 2)
        label = least_labels(len(nodes), at[:, 0], at[:, 1])
        child = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[child]]), pa.array(nodes[child])], ["a", "b"])

    return scratch.keep(links.repartition(1 + links.count() // most).mapInArrow(run, "a long, b long"), name)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and label (the least node reachable) of each node of ``links`` (a, b)."""
    both = scratch.keep(links.union(links.select("b", "a")).toDF("node", "next").distinct(), "both")
    labels = scratch.keep(both.groupBy("node").agg(F.min("next").alias("label")).select("node", F.least("node", "label").alias("label")), "labels0")
    mark = lambda df: df.agg(F.bit_xor(F.xxhash64("node", "label")), F.count(F.lit(1))).first()
    seen, k = mark(labels), 0
    while True:
        k += 1
        around = both.join(labels.select(F.col("node").alias("next"), "label"), "next").select("node", "label")
        lowered = scratch.keep(around.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), f"lowered{k}")
        of = lowered.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = scratch.keep(lowered.join(of, "label").select("node", F.col("root").alias("label")), f"labels{k}")
        scratch.drop(f"lowered{k}", f"labels{k - 1}")
        labels, before, seen = jumped, seen, mark(jumped)
        if seen == before:
            scratch.drop("both")
            return labels


def near_groups(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    of_doc = scratch.keep(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = scratch.keep(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    buckets = hash_tables(fps.select("fp"), scratch)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = buckets.repartition(width, "mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(bucket_links, "a long, b long")
    labels = components(scratch.keep(linked.distinct(), "links"), scratch)
    rooted = scratch.keep(fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("label", "fp").alias("root")), "rooted")
    least = scratch.keep(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = scratch.keep(rooted.join(least, "root").select("fp", "component_id"), "named")
    return of_doc.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes, words: int = WORDS, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The distinct 64-bit hashes of all word shingles, ascending; a text of fewer words is one shingle. ``known``: word hashes to remember."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    if len(known) > REMEMBERED_WORDS:
        known.clear()
    hashes = [known.get(w) for w in parts]
    if None in hashes:
        for w in set(parts).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, SEED)
        hashes = [known[w] for w in parts]
    own = np.array(hashes, np.uint64)
    n = max(1, len(own) - words + 1)
    out = np.full(n, min(len(own), words), np.uint64)
    for k in range(min(words, len(own))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n])
    return np.unique(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def wide_fingerprints(sets: list[np.ndarray], n_words: int) -> np.ndarray:
    """(sets, n_words): 64 majority bits a word, of the sets' hashes mixed anew for each word."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out = np.zeros((len(sets), n_words), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat, size = np.concatenate([sets[k] for k in full]), sizes[full]
    start = np.cumsum(size) - size
    # Runs of at most 255, which eight counters of a byte can hold, and the first run of each set.
    runs_of = -(-size // 255)
    first = np.cumsum(runs_of) - runs_of
    runs = np.repeat(start - 255 * first, runs_of) + 255 * np.arange(int(runs_of.sum()))
    for w in range(n_words):
        h = mixed(flat + np.uint64((w + 1) * 0xD1342543DE82EF95 % (1 << 64))) if w else flat
        word = np.zeros(len(full), np.uint64)
        for k in range(8):
            counts = np.add.reduceat(h >> np.uint64(k) & ONES, runs).view(np.uint8).reshape(-1, 8)
            over = np.add.reduceat(counts.astype(np.int64), first, axis=0) * 2 > size[:, None]
            word |= (over.astype(np.uint64) << (np.uint64(8) * np.arange(8, dtype=np.uint64) + np.uint64(k))).sum(1, dtype=np.uint64)
        out[full, w] = word
    return out


def set_id(of: np.ndarray) -> int:
    """A set's node, as a signed long."""
    return signed(xxhash.xxh3_64_intdigest(of.tobytes(), SEED))


N_WORDS = -(-(SKETCH_BITS + BLOCKS * BLOCK_BITS) // 64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PARITY_BITS / 64): each bit is the parity of the number of shingles that fall to it."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    bit = (mixed(flat + np.uint64(SEED)) % np.uint64(PARITY_BITS)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(sets)), sizes) * PARITY_BITS + bit, minlength=len(sets) * PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.uint64).reshape(len(sets), -1)


def wide_parities(of: np.ndarray) -> np.ndarray:
    """The parities of one set over as many bits as half its shingles, rounded up to a power of two; none if PARITY_BITS are as many. Its halves' exclusive or is that over half the bits."""
    if len(of) <= 2 * PARITY_BITS:
        return np.zeros(0, np.uint64)
    bits = 1 << ((len(of) + 1) // 2 - 1).bit_length()
    counts = np.bincount((mixed(of + np.uint64(SEED)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.uint64)


def differing_parities(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sets' wide parities, the bits that differ over the lesser number of bits."""
    while len(a) != len(b):
        longer = max(a, b, key=len)
        folded = longer[: len(longer) // 2] ^ longer[len(longer) // 2 :]
        a, b = (folded, b) if longer is a else (a, folded)
    return int(np.bitwise_count(a ^ b).sum())


def prefix_length(n: int, least: Fraction) -> int:
    return n - -(-least.numerator * n // least.denominator) + 1


def shingle_order(docs: DataFrame, words: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample, ascending, with their counts there."""
    sample = docs.where(drawn(F.col(id_col), ORDER_DOCS, F.lit(docs.count())))
    sets = sets_of(sample.select(F.col(text_col).alias("text")), words)
    counts = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") >= ORDER_COUNT).orderBy(F.desc("n"), "s").limit(ORDER_SHINGLES).collect()
    keys = np.array([r.s for r in rows], np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], np.array([r.n for r in rows], np.int64)[by]


def nodes_of(docs: DataFrame, words: int, least: Fraction, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node (its set), n (the size of it), bits (fingerprint, an array of longs, of which the first is the sketch), parity (its parities), wide (its wide parities), prefix (its first shingles in order)."""
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, words, id_col, text_col))

    def prefix(of: np.ndarray) -> np.ndarray:
        keys, counts = order.value
        if not len(of):
            return of.view(np.int64)
        count = np.zeros(len(of), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
            count = np.where(keys[at] == of, counts[at], 0)
        return of[np.argsort(count, kind="stable")[: prefix_length(len(of), least)]].view(np.int64)

    def lists(rows: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.view(np.int64).ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py() or b"", words, known) for t in part.column(1)]
                columns = [part.column(0), pa.array([set_id(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), lists(wide_fingerprints(sets, N_WORDS)), lists(parities(sets)), pa.array([wide_parities(x).view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([prefix(x) for x in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n", "bits", "parity", "wide", "prefix"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, node long, n long, bits array<long>, parity array<long>, wide array<long>, prefix array<long>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """node and all shingles of each document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(t.as_py() or b"", words) for t in batch.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, shingles array<long>")


def block_keys() -> list:
    """A column for each table: the hash of its number and of the bits that it keeps. Blocks lie end to end after the sketch."""
    word = lambda k: F.element_at("bits", k + 1)
    masks, out = covering_masks((1 << BLOCK_BITS) - 1, BLOCK_RADIUS), []
    for block in range(BLOCKS):
        k, shift = divmod(SKETCH_BITS + block * BLOCK_BITS, 64)
        held = F.shiftrightunsigned(word(k), shift)
        if shift + BLOCK_BITS > 64:
            held = held.bitwiseOR(F.shiftleft(word(k + 1), 64 - shift))
        out += [F.xxhash64(F.lit(len(masks) * block + i), held.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[np.ndarray]:
    """Rows sorted by their first ``by`` columns, cut only where these change. A column of lists of one length becomes as many."""
    column = lambda c: c.flatten().to_numpy().reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False)[:, None]
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([column(c) for c in batch.columns], 1)
        if held and (held[-1][-1, :by] != rows[0, :by]).any():
            yield np.concatenate(held)
            held = []
        other = np.flatnonzero((rows[:, :by] != rows[-1, :by]).any(1))
        first = int(other[-1]) + 1 if len(other) else 0
        if first:
            yield np.concatenate([*held, rows[:first]])
            held = []
        held.append(rows[first:])
    if held:
        yield np.concatenate(held)


def pairs_within(rows: np.ndarray, by: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(earlier, later) of all pairs of one group; both are distinct within a yield."""
    group = np.concatenate([[0], np.cumsum((rows[1:, :by] != rows[:-1, :by]).any(1))])
    at, lag = np.arange(len(rows)), 1
    while True:
        at = at[at + lag < len(rows)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            return
        yield at, at + lag
        lag += 1


def nearest_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bucket, cell, node, sketch) in this order: pairs (a, b) of those with a close one before them in the cell and the nearest of these. What this leaves out is left to the exact pass."""
    for rows in whole_groups(batches, 2):
        rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])]
        sketch = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
        best, near = np.full(len(rows), SKETCH_FAR + 1, np.uint8), np.zeros(len(rows), np.int64)
        for a, b in pairs_within(rows, 2):
            far = np.bitwise_count(sketch[a] ^ sketch[b])
            better = far < best[b]
            best[b[better]], near[b[better]] = far[better], a[better]
        at = np.flatnonzero(best <= SKETCH_FAR)
        if len(at):
            yield ordered_pairs(rows[at, 2], rows[near[at], 2])


def ordered_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, the lesser first."""
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bucket, node, place) in this order: those of buckets of two sets or more, once each."""
    for rows in whole_groups(batches, 1):
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]
        _, group, sizes = np.unique(rows[:, 0], return_inverse=True, return_counts=True)
        rows = rows[sizes[group] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["bucket", "node", "place"])


def pairs_apart(least: Fraction):
    """From rows (bucket, cell, other, node, place, label, n, parity) in this order: all pairs of differing labels that no bound tells dissimilar."""
    p, q = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 3):
            node, place, label, n = rows[:, 3], rows[:, 4], rows[:, 5], rows[:, 6]
            parity, held, waiting = np.ascontiguousarray(rows[:, 7:]).view(np.uint64), [], 0
            for a, b in pairs_within(rows, 3):
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                # Sets that first meet here have at most so many shingles in common, and at least so many not.
                most = np.minimum(n[a] - place[a], n[b] - place[b])
                some = (p + q) * most >= p * (n[a] + n[b])
                a, b = a[some], b[some]
                differing = np.bitwise_count(parity[a] ^ parity[b]).sum(1, dtype=np.int64)
                some = (p + q) * differing <= (q - p) * (n[a] + n[b])
                if some.any():
                    held.append(np.stack([node[a[some]], node[b[some]]], 1))
                    waiting += len(held[-1])
                if waiting >= CHUNK:
                    yield ordered_pairs(*np.concatenate(held).T)
                    held, waiting = [], 0
            if waiting:
                yield ordered_pairs(*np.concatenate(held).T)

    return run


def undecided(pairs: DataFrame, nodes: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) but for those that wide parities tell dissimilar; pairs with a set that has none stay."""
    p, q = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, stay = batch.column(2).to_numpy(zero_copy_only=False), np.ones(batch.num_rows, bool)
            for k in np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False) & batch.column(4).is_valid().to_numpy(zero_copy_only=False)):
                differing = differing_parities(*(c[int(k)].values.to_numpy().view(np.uint64) for c in batch.columns[3:]))
                stay[k] = (p + q) * differing <= (q - p) * n[k]
            yield batch.select([0, 1]).filter(pa.array(stay))

    side = lambda c: nodes.where(F.size("wide") > 0).select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"wide{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.select("a", "b", F.coalesce(F.col("na") + F.col("nb"), F.lit(0)).alias("n"), "widea", "wideb").mapInArrow(run, "a long, b long")


def dealt(rows: DataFrame, scratch: Scratch, bucket: int) -> DataFrame:
    """Rows (bucket, node, sketch) with the cell of their bucket; leaders of a large one are in all its cells."""
    sample = rows.where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(SAMPLED)) == 0)
    large = sample.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * SAMPLED > bucket)
    large = scratch.keep(large.select("bucket", F.ceil(F.col("n") * SAMPLED / bucket).cast("int").alias("cells")), "large")
    n = large.count()
    if not n:
        return rows.select("bucket", F.lit(0).alias("cell"), "node", "sketch")
    large = F.broadcast(large) if n <= BROADCAST_BUCKETS else large
    cell = F.coalesce(F.pmod(F.xxhash64("node", "bucket", F.lit("cell")), F.col("cells")), F.lit(0)).cast("int")
    own = rows.join(large, "bucket", "left").select("bucket", cell.alias("cell"), "node", "sketch")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("node"))
    leaders = sample.join(large, "bucket").withColumn("rank", rank).where(F.col("rank") <= LEADERS)
    return own.unionByName(leaders.select("bucket", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "node", "sketch"))


def grid(shared: DataFrame, labels: DataFrame, bucket: int) -> DataFrame:
    """Rows (bucket, cell, other, node, place, label) in which all pairs of differing labels of a bucket meet, from rows (bucket, node, place).

    In a bucket of more than ``bucket`` texts, those of the label that most of them have are dealt out in cells, and the rest is copied to each.
    """
    told = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_label = told.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed_ = of_label.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    cells = lambda n: F.when(F.col("n") <= bucket, 1).otherwise(F.greatest(F.lit(1), F.ceil(n / bucket))).cast("int")
    mixed_ = mixed_.select("bucket", F.col("main.label").alias("most"), cells(F.col("main.n")).alias("mains"), cells(F.col("n") - F.col("main.n")).alias("others"))
    rows = told.join(mixed_, "bucket")
    of = lambda n: F.pmod(F.xxhash64("node", F.lit("grid")), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    main = F.transform(every("others"), lambda j: F.struct(of("mains").alias("cell"), j.alias("other")))
    rest = F.transform(every("mains"), lambda i: F.struct(i.alias("cell"), of("others").alias("other")))
    # The rest among itself: with one cell of it, all of it meets above already.
    among = F.transform(every("others"), lambda j: F.struct((-1 - F.least(j, of("others"))).alias("cell"), F.greatest(j, of("others")).alias("other")))
    places = F.when(F.col("label") == F.col("most"), main).when(F.col("others") > 1, F.concat(rest, among)).otherwise(rest)
    return rows.select("bucket", F.explode(places).alias("at"), "node", "place", "label").select("bucket", F.col("at.cell").cast("long").alias("cell"), F.col("at.other").cast("long").alias("other"), "node", "place", "label")


def similar_groups(docs: DataFrame, words: int = WORDS, least: float = LEAST, id_col: str = ID, text_col: str = TEXT, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, node (its set), root (the least node of its component), component_id (the least id of all that pairs of similarity ``least`` or more connect)."""
    spark, bound = docs.sparkSession, Fraction(str(least))
    if not 0 < bound <= 1:
        raise ValueError("least must be above 0 and at most 1")
    scratch = Scratch(spark, "similar")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_doc = scratch.keep(nodes_of(docs, words, bound, id_col, text_col), "documents")
    nodes = scratch.keep(of_doc.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("parity").alias("parity"), F.first("wide").alias("wide")), "nodes")
    rows = nodes.where("n > 0").select(F.explode(F.array(*block_keys())).alias("bucket"), "node", F.element_at("bits", 1).alias("sketch"))
    order = ("bucket", "cell", "node")
    near = dealt(rows, scratch, bucket).repartition(width, "bucket", "cell").sortWithinPartitions(*order).select(*order, "sketch")
    first = scratch.keep(near.mapInArrow(nearest_before, "a long, b long").distinct(), "pairs_first")

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are similar by the full sets of one document of each."""
        about = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "least_id"), f"about_{name}")
        ids = about.select(F.col("least_id").alias("wanted_id")).distinct()
        if about.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
        sets = scratch.keep(sets_of(texts, words).join(F.broadcast(about.select("node")) if about.count() <= BROADCAST_IDS else about.select("node"), "node", "left_semi").dropDuplicates(["node"]), f"sets_{name}")
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        common = F.size(F.array_intersect("x", "y")) * (bound.numerator + bound.denominator)
        return scratch.keep(both.where(common >= bound.numerator * (F.size("x") + F.size("y"))).select("a", "b"), f"links_{name}")

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    far = sum(F.bit_count(F.element_at("bitsa", k).bitwiseXOR(F.element_at("bitsb", k))) for k in range(1, N_WORDS + 1))
    sizes = F.least("na", "nb") * bound.denominator >= F.greatest("na", "nb") * bound.numerator
    links = forest(checked(scratch.keep(first.join(side("a"), "a").join(side("b"), "b").where(sizes & (far <= ALL_FAR)).select("a", "b"), "close_first"), "first"), scratch, "forest_first")
    labels = components(links, scratch)
    # The exact pass.
    tokens = of_doc.select("node", F.posexplode("prefix").alias("place", "bucket")).select("bucket", "node", F.col("place").cast("long").alias("place"))
    tokens = tokens.repartition(width, "bucket").sortWithinPartitions("bucket", "node").mapInArrow(shared_tokens, "bucket long, node long, place long")
    shared = scratch.keep(tokens, "shared")
    meeting = grid(shared, labels, bucket).join(nodes.select("node", "n", "parity"), "node")
    meeting = meeting.repartition(width, "bucket", "cell", "other").sortWithinPartitions("bucket", "cell", "other", "node")
    apart = meeting.select("bucket", "cell", "other", "node", "place", "label", "n", "parity").mapInArrow(pairs_apart(bound), "a long, b long")
    left = undecided(scratch.keep(apart.distinct(), "pairs_second"), nodes, bound)
    links = links.unionByName(forest(checked(scratch.keep(left, "close_second"), "second"), scratch, "forest_second"))
    labels = components(links, scratch)
    rooted = scratch.keep(nodes.join(labels, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("root")), "rooted")
    # Most nodes are their own root, and only those of links share one.
    least_ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = scratch.keep(rooted.join(least_ids, "root").select("node", "root", "component_id"), "named")
    scratch.drop("shared")
    return of_doc.join(named, "node").select("doc_id", "node", "root", "component_id")


def kept_documents(docs: DataFrame, words: int = WORDS, least: float = LEAST, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """The document of least id of each component of ``similar_groups``, with all its columns; of several rows of that id in one component, one of the least node."""

    @F.arrow_udf("long")
    def node(texts: pa.Array) -> pa.Array:
        return mapped(texts.cast(pa.binary()), lambda t: set_id(shingles(t or b"", words)), pa.int64())

    groups = similar_groups(docs, words, least, id_col, text_col).select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")), "root", "node")
    return only_kept(docs, id_col, groups, node(F.col(text_col)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
