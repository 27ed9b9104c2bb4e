"""Operator 3, sharding: an extendible hash directory in which only oversized buckets split on another bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bits of the key's hash, and of a row's own hash behind it, that a directory can use.
KEY_BITS, ROW_BITS = 60, 60
#: Depths looked at in one round, and how many of them lie below the depth at which shards of the limit would be full.
BAND, BELOW = 7, 3


def _bits60(value: Column) -> Column:
    """The first 60 bits of the MD5 of `value` as text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    """The first `depth` bits of a row's 120 as text of zeros and ones."""
    bits = lambda c: F.lpad(F.bin(c), 60, "0")
    if depth <= KEY_BITS:
        return F.substring(bits("key_hash"), 1, depth)
    return F.concat(bits("key_hash"), F.substring(bits("row_hash"), 1, depth - KEY_BITS))


def _leaves(buckets: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """(prefix, shard, depth, shard_bytes): for buckets of `last` bits the least depth from `first` at which they fit.

    shard is null where none does. Every level's sums are taken over the partitions of the first `first` bits, in
    which all buckets of a longer prefix lie, so the buckets are shuffled once for all levels.
    """
    at = buckets.select(F.substring("prefix", 1, first).alias("top"), "prefix", "n", "bytes").repartition("top")
    found = []
    for depth in range(first, last + 1):
        level = Window.partitionBy("top", F.substring("prefix", 1, depth)) if depth > first else Window.partitionBy("top")
        at = at.withColumns({f"n{depth}": F.sum("n").over(level), f"bytes{depth}": F.sum("bytes").over(level)})
        fits = (F.col(f"bytes{depth}") <= limit) | (F.col(f"n{depth}") == 1)
        found.append(F.when(fits, F.struct(F.substring("prefix", 1, depth).alias("shard"), F.lit(depth).alias("depth"), F.col(f"bytes{depth}").alias("shard_bytes"))))
    return at.select("prefix", F.coalesce(*found).alias("leaf")).select("prefix", "leaf.*")


def _shallower(buckets: DataFrame, leaves: DataFrame, first: int, limit: int) -> DataFrame:
    """`leaves`, with those that fit at `first` already moved up for as long as their parents fit as well."""
    while first > 0 and not leaves.filter(F.col("depth") == first).isEmpty():
        above = max(0, first - BAND)
        tops = written(buckets.groupBy(F.substring("prefix", 1, first).alias("prefix")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), "buckets")
        up = written(_leaves(tops, above, first - 1, limit).filter("shard is not null").select(F.col("prefix").alias("parent"), *(F.col(c).alias(f"up_{c}") for c in ("shard", "depth", "shard_bytes"))), "leaves")
        if up.isEmpty():
            break
        met = leaves.join(up, (F.col("depth") == first) & (F.col("shard") == F.col("parent")), "left")
        leaves = written(met.select("prefix", *(F.coalesce(f"up_{c}", c).alias(c) for c in ("shard", "depth", "shard_bytes"))), "leaves")
        buckets, first = tops, above
    return leaves


def extendible_shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return key, n_bytes (UTF-8), shard (its hash prefix in bits), depth and shard_bytes for every row.

    A shard is the shortest prefix whose rows have at most `limit` bytes together; a single row above the limit is a
    shard of its own. Rows with one key share 60 bits; should they be too many for a shard they split on bits of
    their own, so a hot key, nulls included, and repeated rows split like any other. Null texts have no bytes and an
    empty table gives an empty one; a very long text counts by its length only. Columns other than key and text are
    left out, whatever their names. Each round sums rows to buckets of one depth, a few for each full shard, and
    looks at BAND depths; only rows of buckets that don't fit go on. The plan is the same at every size: rows meet
    their buckets by a join on the prefix, in which Spark splits a skewed one.
    """
    sized = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    rows = written(sized.select("key", "n_bytes", _bits60(F.col("key")).alias("key_hash"), _bits60(F.col("row")).alias("row_hash")), "sizes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    last, done = min(KEY_BITS, math.ceil(math.log2(max(1, total / limit))) + BELOW), []
    first = max(0, last - BAND + 1)
    while True:
        here = rows.withColumn("prefix", _prefix(last))
        buckets = written(here.groupBy("prefix").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")), "buckets")
        leaves = written(_leaves(buckets, first, last, limit), "leaves")
        if not done:  # later rounds begin below buckets that are known not to fit
            leaves = _shallower(buckets, leaves, first, limit)
        placed = here.join(leaves.hint("merge"), "prefix")
        done.append(placed.filter("shard is not null").select(F.col("key").alias(key), "n_bytes", "shard", "depth", "shard_bytes"))
        if last == KEY_BITS + ROW_BITS or leaves.filter("shard is null").isEmpty():
            break
        rows = written(placed.filter("shard is null").select("key", "n_bytes", "key_hash", "row_hash"), "sizes")
        first, last = last + 1, min(KEY_BITS + ROW_BITS, last + BAND)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def directory(shards: DataFrame) -> DataFrame:
    """(first, last, depth, shard): the range of directory slots, at the global depth, that point to each shard."""
    leaves = shards.select("shard", "depth").distinct()
    deepest = leaves.agg(F.max("depth").alias("global_depth"))
    slot = F.coalesce(F.conv("shard", 2, 10).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    width = F.pow(F.lit(2.0), F.col("global_depth") - F.col("depth")).cast("decimal(38,0)")
    return leaves.crossJoin(F.broadcast(deepest)).select((slot * width).alias("first"), (slot * width + width - 1).alias("last"), "depth", "shard")


def write_shards(docs: DataFrame, shards: DataFrame, key: str, path: str) -> None:
    """Write `docs`, whose keys are unique and not null, as one folder for each shard; a shard is at most one task's work.

    Keys that repeat are refused: the table of shards doesn't tell which of their rows lies in which shard.
    """
    if not docs.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} isn't unique")
    docs.join(shards.select(key, "shard"), key).repartition("shard").write.partitionBy("shard").parquet(path)
