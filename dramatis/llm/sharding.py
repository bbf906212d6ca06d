"""Minimax contiguous partition of a table into shards of nearly equal bytes; native throughout.

Method: equal texts form atomic groups, which are ordered by the hash of their text. Groups
with the same leading hash bits make one atom, so there are at most ATOMS atoms at any input
size, and a group never spans two. A binary search finds the smallest capacity for which a
greedy left-to-right fill needs no more shards than there are. Each cut then lies as near to
the even share as that capacity allows, on both sides: a shard neither exceeds it, nor leaves
more to the shards after it than they can hold.

An atom above the even share of what is left (one text may be a third of all rows) takes a shard of
its own before the search, since otherwise it would set the capacity for all the others.

All is SQL: the sizes of the atoms are summed map-side, the search runs over one array of
bounded length, and atoms map to shards by a broadcast of ATOMS rows. Slots are numbered within
(shard, cell), cells being hashed from the id, so a text with a third of all rows is spread.

Defined results: a null text counts as empty. Law is `bytes`, so grown_shard is null. Rows that
repeat an id are rows of their own. An empty table gives an empty result. Shards may stay empty
if there are fewer atoms than shards. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramatis.llm.common import ID, TEXT, Scratch, table

SHARDS, ROW_BYTES = 24, 8
#: Atoms of the search, and cells in which the rows of a shard are numbered.
ATOMS, CELLS = 65_536, 512


def plan_sql(shards: int, atoms: int) -> str:
    """From view `sizes` (atom int, bytes long): one row (atom, shard) for each possible atom."""
    fill = "aggregate({sizes}, named_struct('n', 1L, 'held', 0L), (a, x) -> if(a.held + x.bytes <= {capacity}, named_struct('n', a.n, 'held', a.held + x.bytes), named_struct('n', a.n + 1, 'held', x.bytes)), a -> a.n)"
    none = "cast(array() as array<int>)"
    return f"""
WITH listed AS (SELECT sort_array(collect_list(named_struct('atom', atom, 'bytes', bytes))) AS all_atoms, coalesce(sum(bytes), 0L) AS total FROM sizes),
giants AS (SELECT *, aggregate(slice(sort_array(transform(all_atoms, x -> named_struct('bytes', x.bytes, 'atom', x.atom)), false), 1, {shards - 1}),
  named_struct('rest', total, 'open', true, 'atoms', {none}),
  (a, x) -> if(a.open AND x.bytes * ({shards} - size(a.atoms)) > a.rest,
    named_struct('rest', a.rest - x.bytes, 'open', true, 'atoms', concat(a.atoms, array(x.atom))),
    named_struct('rest', a.rest, 'open', false, 'atoms', a.atoms))) AS g FROM listed),
others AS (SELECT g.atoms AS giants, g.rest AS total, {shards} - size(g.atoms) AS k, filter(all_atoms, x -> NOT array_contains(g.atoms, x.atom)) AS list FROM giants),
searched AS (SELECT *, aggregate(sequence(1, 63), named_struct('low', greatest(coalesce(array_max(transform(list, x -> x.bytes)), 0L), cast(ceil(total / k) AS long)), 'high', total),
  (r, i) -> if(r.low >= r.high, r, if({fill.format(sizes="list", capacity="(r.low + r.high) div 2")} <= k,
    named_struct('low', r.low, 'high', (r.low + r.high) div 2), named_struct('low', (r.low + r.high) div 2 + 1, 'high', r.high))), r -> r.low) AS capacity FROM others),
-- starts[m]: the first atom from which m + 1 shards of that capacity hold all that follows, filled from the right
backward AS (SELECT *, aggregate(reverse(list), named_struct('held', 0L, 'last', cast(null as int), 'starts', {none}),
  (a, x) -> if(a.held + x.bytes <= capacity, named_struct('held', a.held + x.bytes, 'last', x.atom, 'starts', a.starts),
    named_struct('held', x.bytes, 'last', x.atom, 'starts', concat(a.starts, array(a.last)))), a -> concat(a.starts, array(a.last))) AS starts FROM searched),
forward AS (SELECT *, aggregate(list, named_struct('held', 0L, 'sum', 0L, 'cuts', {none}),
  (a, x) -> if(size(a.cuts) < k - 1 AND a.held > 0 AND (a.held + x.bytes > capacity
      OR a.sum + x.bytes / 2 > total * (size(a.cuts) + 1) / k AND x.atom >= coalesce(try_element_at(starts, k - 1 - size(a.cuts)), -1)),
    named_struct('held', x.bytes, 'sum', a.sum + x.bytes, 'cuts', concat(a.cuts, array(x.atom))),
    named_struct('held', a.held + x.bytes, 'sum', a.sum + x.bytes, 'cuts', a.cuts)), a -> a.cuts) AS cuts FROM backward)
SELECT atom, cast(if(array_contains(giants, atom), k - 1 + array_position(giants, atom), size(filter(cuts, c -> c <= atom))) AS int) AS shard
FROM (SELECT giants, k, cuts, explode(sequence(0, {atoms - 1})) AS atom FROM forward)
"""


def shard_rows(docs: DataFrame, shards: int = SHARDS, atoms: int = ATOMS, cells: int = CELLS, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.keep(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(atoms)).cast("int").alias("atom"),
            F.pmod(F.xxhash64(F.col(id_col), F.lit("cell")), F.lit(cells)).cast("int").alias("cell"),
        ),
        "rows",
    )
    sizes = rows.groupBy("atom").agg(F.sum("size").alias("bytes"))
    plan = scratch.keep(spark.sql(plan_sql(shards, atoms).replace("FROM sizes", "FROM {sizes}"), sizes=sizes), "plan")
    placed = rows.join(F.broadcast(plan), "atom")  # ATOMS rows at any size of the input
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32"))
    # Shards times CELLS rows, again at any size.
    return placed.withColumn("rank", within).join(F.broadcast(offsets), ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
