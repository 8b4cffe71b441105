"""Two-pass external shuffle into shards.

Pass one scatters the records by seeded hashes into buckets that fit a task's memory; pass two shuffles each bucket
by Fisher-Yates with a generator seeded by the bucket, after bringing its rows into a fixed order, so a lost task
repeats its result, and ``write_shards`` writes it. A record's shard is the one whose seeded hash with ``doc_id`` is
highest, so ``doc_id`` and the shard count decide, and one more shard takes rows only into itself (law ``key``).

A shard has as many buckets as its own bytes need, so a hot ``doc_id`` gives its shard more buckets, not larger ones.
Only rows that repeat id and text would still meet in one bucket: where a bucket is too large for that reason, its
repeated rows are numbered, the numbers are written to the shared folder, and they are scattered by number too.

Defined cases: a null text has size 1; a null ``doc_id`` counts as an id of its own; repeated rows are all kept, in
the same shard; a text larger than a bucket is a bucket's only surplus; an empty table gives empty shards; other
columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistalake.llm.common import broadcast_small, fresh_name, materialize, scratch_path, table

SHARDS, SEED = 16, 2024
#: Bytes of text in a bucket, on average: what one task holds in memory.
BUCKET_BYTES = 24 << 20
#: Rows about buckets that may be broadcast, and partitions that buckets are dealt to; a task holds one bucket at a time.
BROADCAST_BUCKETS, MOST_PARTITIONS = 200_000, 20_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus one."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest seeded hash of the id; the lower shard wins a tie."""
    ranked = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), doc_id).alias("h"), F.lit(-s).alias("s")) for s in range(shards)]
    return -F.greatest(*ranked).getField("s")


def _fisher_yates(seed: int, shard: str, bucket: str, order: tuple[str, str], place: str):
    """Shuffles one bucket. The fixed order before it makes the result depend on the rows alone."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order]))
        n = rows.num_rows
        # Generator.permutation is a Fisher-Yates pass over the row numbers.
        drawn = np.random.default_rng([seed, rows.column(shard)[0].as_py(), rows.column(bucket)[0].as_py()]).permutation(n)
        rows = rows.take(pa.array(drawn))
        return rows.set_column(rows.column_names.index(place), place, pa.array(np.arange(n, dtype=np.int64)))

    return run


def shuffle_into_shards(documents: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents with ``shard`` and ``slot`` (gapless in a shard), physically in shuffled order per bucket."""
    names = list(documents.columns)
    shard, slot, bucket, first_key, then_key, place, start, at_shard, at_bucket = (
        fresh_name(names, x) for x in ("shard", "slot", "bucket_number", "row_order", "row_tie", "bucket_place", "bucket_first", "start_shard", "start_bucket")
    )
    size = size_of(F.col("text"))
    placed = documents.withColumn(shard, shard_of(F.col("doc_id"), shards, seed).cast("int"))
    held = {r[0]: r.n for r in placed.groupBy(shard).agg(F.sum(size).alias("n")).collect()}  # a row for each shard
    buckets = F.array(*(F.lit(max(1, -(-int(held.get(s, 0)) // bucket_bytes))) for s in range(shards)))
    key = F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text").cast("string"))
    number = lambda h: F.pmod(h, F.element_at(buckets, F.col(shard) + 1).cast("long")).cast("int")
    keyed = placed.withColumn(bucket, number(key))
    counted = lambda rows: rows.groupBy(F.col(shard).alias(at_shard), F.col(bucket).alias(at_bucket)).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    counts = materialize(counted(keyed), "bucket-counts")
    here = (F.col(shard) == F.col(at_shard)) & (F.col(bucket) == F.col(at_bucket))
    large = counts.where(F.col("bytes") > 2 * bucket_bytes).drop("n", "bytes")
    if large.limit(1).count():
        row_key = fresh_name(names, "row_key")
        inside = keyed.join(broadcast_small(large, BROADCAST_BUCKETS), here, "left_semi").select(key.alias(row_key), size.alias("size"))
        heavy = inside.groupBy(row_key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where((F.col("n") > 1) & (F.col("bytes") > bucket_bytes // 4))
        heavy = broadcast_small(materialize(heavy.select(row_key), "heavy-keys"), BROADCAST_BUCKETS)
        # Numbers depend on how the rows were read, so they are fixed by writing them before rows are dealt by them.
        spread = placed.join(heavy, key == F.col(row_key), "left_semi").withColumn(bucket, number(F.xxhash64(F.lit(seed + 4), F.monotonically_increasing_id())))
        keyed = keyed.join(heavy, key == F.col(row_key), "left_anti").unionByName(materialize(spread, "numbered-rows"))
        counts = materialize(counted(keyed), "bucket-counts")
    # Where each bucket starts in its shard: sums over the narrow table of buckets, on the executors.
    starts = counts.select(at_shard, at_bucket, F.expr(f"coalesce(sum(n) OVER (PARTITION BY `{at_shard}` ORDER BY `{at_bucket}` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias(start))
    # Any further difference between rows decides last, so that equal ids and texts keep a fixed order too.
    plain = [F.col(c).cast("string") if isinstance(documents.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(c) for c in names]
    ordered = keyed.withColumns({first_key: F.xxhash64(F.lit(seed + 2), F.col("doc_id"), F.col("text").cast("string")), then_key: F.xxhash64(F.lit(seed + 3), *plain), place: F.lit(0).cast("long")})
    parts = min(max(counts.count(), int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_PARTITIONS)
    dealt = ordered.join(broadcast_small(starts, BROADCAST_BUCKETS), here).drop(at_shard, at_bucket).repartition(parts, shard, bucket)
    shuffled = dealt.groupBy(shard, bucket).applyInArrow(_fisher_yates(seed, shard, bucket, (first_key, then_key), place), dealt.schema)
    return shuffled.select(*names, shard, (F.col(start) + F.col(place)).alias(slot))


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder for each shard; rows in a file are in slot order."""
    sharded.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 16 shards and written, read back, with where one more shard would have put them."""
    path = scratch_path(spark, "shards")
    sharded = shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    schema = sharded.schema
    write_shards(sharded, path)
    return spark.read.schema(schema).parquet(path).select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        shard_of(F.col("doc_id"), SHARDS + 1).cast("int").alias("grown_shard"),
    )
