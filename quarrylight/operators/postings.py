"""A positional inverted index as a table, and ranking by cover density over the postings of a query's tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import casefold

#: Fixed weight of a token without a label in the cover-density rank.
WEIGHT = 0.1
#: Folders of an index; a token is in the one that its hash names. Parts of a folder, by the hash of a key. And texts
#: whose words a worker groups at once.
BUCKETS, PARTS, SLICE = 64, 8, 512


def _by_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, positions) of each row by itself. Words are grouped by codes where they are, so that none is
    shuffled or sorted as text; SLICE rows at a time leave a task."""
    words = F.regexp_extract_all(casefold(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                held = part.column(1)
                n = pc.list_value_length(held).to_numpy(zero_copy_only=False)
                row, flat = np.repeat(np.arange(len(n)), n), held.flatten()
                place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1
                kept = np.flatnonzero(pc.greater(pc.utf8_length(flat), 1).to_numpy(zero_copy_only=False))
                coded = flat.take(pa.array(kept)).dictionary_encode()
                size = max(1, len(coded.dictionary))
                group = row[kept] * size + coded.indices.to_numpy()
                order = np.argsort(group, kind="stable")
                group = group[order]
                first = np.flatnonzero(np.diff(group, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(group)), pa.int32()), pa.array(place[kept][order], pa.int32()))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(group[first] % size)), part.column(0).take(pa.array(group[first] // size)), lists], names=["token", key, "positions"])

    schema = StructType([StructField("token", StringType()), docs.schema[key], StructField("positions", ArrayType(IntegerType()))])
    return docs.select(key, words.alias("words")).filter("words is not null").mapInArrow(gather, schema)


def _merged(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def positions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, positions): where each folded word of two or more characters stands, from 1; all words are counted.

    A token of every text is as many rows as texts, so no key of the grouping is hot. Null texts have no rows; those
    of several rows of one key are merged.
    """
    return _merged(_by_text(docs, key, text), ["token", key])


def _bucket(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Write positions() below `path`, a folder for each bucket, sorted by token.

    Postings are dealt once, by bucket and one of PARTS parts of the keys, so that a frequent token's spread over
    files. They are merged only where keys repeat. A token's row groups are found by their bounds.
    """
    dealt = ["bucket", "part"]
    found = _by_text(docs, key, text).withColumns({"bucket": _bucket(F.col("token")), "part": F.pmod(F.xxhash64(key), F.lit(PARTS))}).repartition(*dealt)
    if not docs.groupBy(key).count().filter("count > 1").isEmpty():
        found = _merged(found, [*dealt, "token", key])
    found.drop("part").sortWithinPartitions("bucket", "token", key).write.partitionBy("bucket").parquet(path)


def postings(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """(token, key, positions) of the tokens: their folders only are listed, and their row groups read."""
    index = spark.read.parquet(path)
    if not tokens:
        return index.drop("bucket").limit(0)
    buckets = [r["b"] for r in spark.createDataFrame([(t,) for t in tokens], "token string").select(_bucket(F.col("token")).alias("b")).distinct().collect()]
    return index.filter(F.col("bucket").isin(buckets) & F.col("token").isin(tokens)).drop("bucket")


def cover_density(found: DataFrame, key: str, tokens: list[str], every: bool = False) -> DataFrame:
    """(key, covers, density) of the texts that hold any token, or with `every` all of them.

    A cover is a shortest stretch of text that satisfies the query: any token by itself, or from one to the last that
    completes the set. It adds WEIGHT, divided by one more than the words in it that the query doesn't name. Of
    stretches with the same first token the shortest counts.
    """
    if not every:
        return found.groupBy(key).agg(F.sum(F.size("positions")).alias("covers"), (WEIGHT * F.sum(F.size("positions"))).alias("density"))
    each = found.select(key, "token", F.explode("positions").alias("at"))
    upto = Window.partitionBy(key).orderBy("at")
    placed = each.withColumn("nth", F.row_number().over(upto))
    starts = [F.max(F.when(F.col("token") == t, F.struct("at", "nth"))).over(upto) for t in tokens]  # a position carries its number
    start = F.when(sum((s.isNotNull().cast("int") for s in starts), F.lit(0)) == len(tokens), F.array_min(F.array(*starts)))
    ended = placed.withColumn("_s", start).filter("_s is not null").select(key, "at", "nth", F.col("_s.at").alias("start"), F.col("_s.nth").alias("from"))
    ends = ended.groupBy(key, "start").agg(F.min("at").alias("end"), F.min("nth").alias("to"), F.min("from").alias("from"))
    covers = ends.select(key, (WEIGHT / (1 + (F.col("end") - F.col("start")) - (F.col("to") - F.col("from")))).alias("part"))
    return covers.groupBy(key).agg(F.count("*").alias("covers"), F.sum("part").alias("density"))


def lexical_rank(found: DataFrame, key: str, tokens: list[str], k: int, every: bool = False) -> DataFrame:
    """(key, lexical): the `k` densest texts, ties by key, with densities as shares of the highest."""
    top = cover_density(found, key, tokens, every).orderBy(F.desc("density"), key).limit(k)
    return top.select(key, (F.col("density") / F.max("density").over(Window.partitionBy(F.lit(0)))).alias("lexical"))  # k rows
