"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words: space, and tab to carriage return.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`; the optimiser can't inline it into a lambda."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """`text` with every word break as a plain space."""
    for c in WORD_BREAKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than WORD_BREAKS, in order (null text: none)."""
    return F.array_remove(F.split(spaced(F.coalesce(text, F.lit(""))), " "), "")


def held(docs: DataFrame, **columns: Column) -> DataFrame:
    """`docs` as one struct column "docs" beside `columns`: whatever names a user's table has, they can't meet those
    of an operator's own columns. released() gives them back."""
    return docs.select(F.struct("*").alias("docs"), *(c.alias(name) for name, c in columns.items()))


def released(rows: DataFrame, *added: str) -> DataFrame:
    """The columns of held() and behind them `added`, which take the place of columns of the same names."""
    taken = {name.lower() for name in added}
    fields = rows.schema["docs"].dataType.names
    return rows.select(*(F.col("docs").getField(name).alias(name) for name in fields if name.lower() not in taken), *added)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a session on one machine
    (local mode, as in tests) gets a new one; on a cluster that is an error, as executors can't share a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarrylight-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table that written() made, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of 64 bits that tell which ids a table may hold: some 30 MB, however long the table.
FILTER_WORDS = 1 << 20


def _flagged(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """`rows` with "_maybe", whether `key` may be in `ids`: looked up in a broadcast bitmap of FILTER_WORDS at the most."""
    place = lambda: F.pmod(F.xxhash64(key), F.lit(64 * FILTER_WORDS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63).cast("int"))
    words = ids.select(place().alias("_p")).groupBy(F.shiftright("_p", 6).alias("_word")).agg(F.bit_or(bit(F.col("_p"))).alias("_bits"))
    met = rows.withColumn("_p", place()).join(F.broadcast(words), F.shiftright("_p", 6) == F.col("_word"), "left")
    return met.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit(F.col("_p"))) != 0, F.lit(False))).drop("_p", "_word", "_bits")


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose `key` is in `ids` (one column of that name). Rows are shuffled only where a bitmap of fixed size
    says that they may be among them."""
    return _flagged(rows, ids, key).filter("_maybe").drop("_maybe").join(ids.select(key), key, "left_semi")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose `key` is not in `ids`, shuffled as by among(). No key is null."""
    flagged = _flagged(rows, ids, key)
    return flagged.filter("not _maybe").drop("_maybe").unionByName(flagged.filter("_maybe").drop("_maybe").join(ids.select(key), key, "left_anti"))
