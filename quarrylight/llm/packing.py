"""Operator 10, best-fit packing: bins ordered by residual, with bitmaps of the sources and copy clusters inside."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Documents packed together in one task; more documents make more blocks. README has what that costs in bins.
BLOCK = 8192
#: Equal rows that are written out at once.
RUN = 1024


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each item (length at most `capacity`, source bit, cluster bit; bits may be zero), in the order given.

    An item goes to the tightest bin that has room and shares no bit with it: the search starts at the least
    residual that suffices and goes on to the next until a bin is compatible; else a new bin opens. Of bins with
    one residual the oldest is first.
    """
    order: list[tuple[int, int]] = []  # (residual, bin) of bins with room left
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in items:
        i = bisect_left(order, (length, -1))
        while i < len(order) and (sources[order[i][1]] & source or clusters[order[i][1]] & cluster):
            i += 1
        if i < len(order):
            residual, bin_ = order.pop(i)
        else:
            residual, bin_ = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[bin_] |= source
        clusters[bin_] |= cluster
        if residual > length:
            insort(order, (residual - length, bin_))
        out.append(bin_)
    return out


def _bits(values: pd.Series) -> list[int]:
    """A bit for each value that occurs twice or more; others, and nulls, conflict with nothing."""
    counts = values.value_counts()
    bit = {v: 1 << i for i, v in enumerate(counts.index[counts > 1])}
    return [0 if pd.isna(v) else bit.get(v, 0) for v in values]


def packed(docs: DataFrame, capacity: int, length: str, source: str = "source", cluster: str = "cluster", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Return doc_id, piece, start, length and bin for every piece of every row.

    A row longer than `capacity` gives full pieces, each a bin of its own, and a rest. Rests are packed by best fit,
    longest first, ties by id, so that no bin holds two rows of one source or of one cluster. Rows are dealt to
    blocks of about `block` by a hash of id, length, source, cluster and a number among equal rows, so bins follow the
    rows alone, not their places in files; each block has its own bins, so memory is bounded and no row is left out.
    Rows without length have one empty piece and no bin (null). Null
    sources and clusters conflict with nothing; null ids and repeated rows are rows of their own; an empty table gives
    an empty one; a very long text counts by its length only. Columns other than these four are left out, whatever
    their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"))
    keys = ["doc_id", "length", "source", "cluster"]
    alike = written(rows.groupBy(*keys).agg(F.count("*").alias("n")), "lengths")
    blocks = max(1, math.ceil((alike.agg(F.sum("n")).first()[0] or 0) / block))
    runs = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))))
    each = runs.withColumn("row", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)))
    dealt = each.select(*keys, F.pmod(F.xxhash64(*keys, "row"), F.lit(blocks)).alias("block"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys, ignore_index=True)  # whatever order the shuffle gave
        rest = pdf.assign(rest=pdf["length"] % capacity).sort_values(["rest", *keys], ascending=[False, True, True, True, True])
        rest = rest[rest["rest"] > 0]
        bins = best_fit(list(zip(rest["rest"].tolist(), _bits(rest["source"]), _bits(rest["cluster"]))), capacity)
        next_bin, first = max(bins, default=-1) + 1, int(pdf["block"].iloc[0]) << 32
        out = []
        for doc, n, bin_ in zip(rest["doc_id"], rest["length"].tolist(), bins):
            out.append((doc, n // capacity, n - n % capacity, n % capacity, first + bin_))
        for doc, n in zip(pdf["doc_id"], pdf["length"].tolist()):
            if n == 0:
                out.append((doc, 0, 0, 0, None))
            for piece in range(n // capacity):
                out.append((doc, piece, piece * capacity, capacity, first + next_bin))
                next_bin += 1
        found = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "bin"])
        return found.astype({"doc_id": pdf["doc_id"].dtype, "bin": "Int64"})

    kind = dict(rows.dtypes)["doc_id"]
    return dealt.groupBy("block").applyInPandas(pack, f"doc_id {kind}, piece long, start long, length long, bin long")
