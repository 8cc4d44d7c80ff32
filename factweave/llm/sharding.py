"""Sharding by extendible hashing.

A document's hash is the first 60 bits of md5(doc_id). The directory starts with one bucket; a bucket over the byte limit splits on the next bit of its prefix, and only
such buckets do, until every shard fits. A document's shard is thus the shortest prefix of its hash whose bucket fits.

Bytes are summed once for prefixes of a depth that the total suggests; shorter prefixes follow from these sums, and only buckets still over the
limit at that depth are summed anew with more bits. Nothing of the size of the corpus goes to one task or to the driver.

Edge cases: null or empty texts have 0 bytes; a null doc_id hashes as the text ''; rows with the same doc_id can't be told apart by any bit and share
a shard, as does a document over the limit by itself (`fits` is false where that leaves a shard too large at 60 bits); an empty table gives no rows; other columns are ignored by `assign` and kept by `write_shards`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.util import materialise, shuffle_partitions

BITS = 60
MAX_BYTES = 4 << 20


def doc_hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def directory(sized: DataFrame, max_bytes: int, step: int = 8) -> DataFrame:
    """Leaves (depth, prefix, shard_bytes) for sized(h, n_bytes)."""
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / max_bytes)))) + 3)
    above, left, leaves = -1, sized, []
    while True:
        # sums at this depth, spread to all depths between the last one and this; each row goes to as many rows as there are depths
        fine = materialise(left.groupBy(prefix(F.col("h"), depth).alias("p")).agg(F.sum("n_bytes").alias("b")), "buckets")
        each = fine.select(F.explode(F.sequence(F.lit(above + 1), F.lit(depth))).alias("depth"), "p", "b")
        sums = each.groupBy("depth", F.call_function("shiftright", F.col("p"), F.lit(depth) - F.col("depth")).alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.min("p").alias("p"))
        # of the buckets that fit, those whose parent doesn't: a bucket's bytes never exceed its parent's
        parent = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("shard_bytes").alias("up_bytes"))
        sums = sums.withColumn("up", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        leaf = (F.col("shard_bytes") <= max_bytes) | (F.col("depth") == BITS)
        leaves.append(sums.join(parent, ["depth", "up"], "left").filter(leaf & (F.col("up_bytes").isNull() | (F.col("up_bytes") > max_bytes))).select("depth", "prefix", "shard_bytes"))
        if depth == BITS:
            break
        over = fine.filter(F.col("b") > max_bytes).select("p")
        if over.isEmpty():
            break
        left = left.withColumn("p", prefix(F.col("h"), depth)).join(over, "p", "left_semi").drop("p")
        above, depth = depth, min(BITS, depth + step)
    return materialise(reduce(DataFrame.unionByName, leaves), "directory")


def assign(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_bytes, depth, shard (the prefix's bits), shard_bytes and fits, for each row of docs(doc_id, text)."""
    sized = materialise(docs.select("doc_id", doc_hash(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "sized")
    leaves = directory(sized, max_bytes)
    # a bucket that is short of the deepest level stands for many directory entries; joining level by level needs none of these
    out, key = None, F.col("h")
    for d in sorted({r[0] for r in leaves.select("depth").distinct().collect()}):
        at = leaves.filter(F.col("depth") == d)
        hit = sized.withColumn("prefix", prefix(key, d)).join(at, "prefix")
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        out = sized.withColumn("prefix", F.lit(0).cast("long")).join(leaves, "prefix")
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return out.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), bits.alias("shard"), "shard_bytes", (F.col("shard_bytes") <= max_bytes).alias("fits"))


def write_shards(docs: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> None:
    """Writes docs with all columns, each shard as one folder shard=<bits>; every shard is one task's file of at most max_bytes of text."""
    where = assign(docs.select("doc_id", "text"), max_bytes).select("doc_id", F.concat(F.lit("b"), "shard").alias("shard")).distinct()
    n = shuffle_partitions(docs.sparkSession)
    docs.join(where, docs.doc_id.eqNullSafe(where.doc_id), "inner").drop(where.doc_id).repartition(n, "shard").write.partitionBy("shard").parquet(path)


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The leaf of a document is the shortest prefix whose bucket fits; 24 bits are more than these tables need.
OP5_SQL = f"""
with d as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents
), e as (
  select doc_id, n_bytes, u.depth, h >> ({BITS} - u.depth) as prefix from d, (select unnest(range(0, 25)) as depth) u
), b as (
  select *, (sum(n_bytes) over (partition by depth, prefix))::bigint as shard_bytes from e
), l as (
  select * from b where shard_bytes <= {MAX_BYTES} qualify row_number() over (partition by doc_id order by depth) = 1
)
select doc_id, n_bytes, depth::int as depth, case when depth = 0 then '' else lpad(bin(prefix), depth::int, '0') end as shard, shard_bytes, true as fits from l
"""
