"""Vector scalars over arrays of numbers, evaluated in the JVM, and an embedding by hashing, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .text import casefold

#: Length of a hashing embedding.
HASH_SIZE = 96
#: Texts whose values leave a task at once, and tokens whose places a worker remembers, some 15 MB.
SLICE, KNOWN = 256, 1 << 16
#: What its tokens are.
TOKEN = re.compile(r"[\w+#.]{2,}")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in array order; a missing element of the shorter array counts as null, giving null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def strict_cosine(a: Column, b: Column) -> Column:
    """Cosine that fails on vectors of different lengths and is 0 where a norm is 0."""
    size = norm(a) * norm(b)
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return checked.otherwise(F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size))


def lenient_cosine(a: Column, b: Column) -> Column:
    """Cosine that is 0 on vectors of different lengths, empty ones, or a norm of 0."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    """The vector divided by its norm; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def sigmoid(x: Column) -> Column:
    """Logistic function of `x` clipped to [-50, 50]."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))))


@lru_cache(maxsize=KNOWN)
def _place(token: str) -> int:
    """A token's bucket, negative below zero where its sign is minus: the first four bytes of its SHA-256 give the
    bucket, the low bit of the fifth the sign (set: plus)."""
    digest = hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()
    bucket = int.from_bytes(digest[:4], "big") % HASH_SIZE
    return bucket if digest[4] & 1 else ~bucket


def _embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bucket, value) of (key, text) batches; SLICE texts at a time leave a task, and none is copied before its turn."""
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            rows, buckets, values = [], [], []
            for row in range(low, min(batch.num_rows, low + SLICE)):
                total = np.zeros(HASH_SIZE, np.int64)
                for token, n in Counter(TOKEN.findall(batch.column(1)[row].as_py() or "")).items():
                    at = _place(token)
                    total[at if at >= 0 else ~at] += n if at >= 0 else -n
                used = np.flatnonzero(total)
                rows.append(np.full(len(used), row, np.int64))
                buckets.append(used)
                values.append(total[used] / np.sqrt(float((total * total).sum())) if len(used) else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(buckets), pa.int64()), pa.array(np.concatenate(values), pa.float64())], names=[batch.schema.names[0], "bucket", "value"])


def hash_embedding(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, value): signed hash counts of tokens over HASH_SIZE buckets, scaled to norm 1 and rounded to 8 digits.

    Tokens are runs of two or more of letters, digits, "_", "+", "#" and "."; buckets of value 0 are left out. A row's
    work is its own: each distinct token is hashed once, in Arrow batches, and nothing is shuffled.
    """
    rows = docs.select(key, casefold(F.col(text)).alias("_text"))
    found = rows.mapInArrow(_embedded, StructType([rows.schema[0], StructField("bucket", LongType()), StructField("value", DoubleType())]))
    return found.withColumn("value", F.round("value", 8))
