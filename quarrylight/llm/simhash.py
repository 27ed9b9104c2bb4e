"""Operator 4, SimHash near-duplicates: multi-index hashing over fingerprint segments, then connected components."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, written
from .components import connected_components

#: For each value of a byte its eight bits, the highest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Choices of fingerprint segments as (width, Hamming radius), for more and more fingerprints. Two of them at most
#: MAX_DISTANCE bits apart come within the radius of at least one segment, as the radii plus one each sum to more.
SEGMENTS = (((13, 0), (13, 0), (13, 0), (13, 0), (12, 0)), ((22, 1), (22, 1), (20, 0)), ((32, 2), (32, 1)))
MAX_DISTANCE = 4


def shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """8-byte hashes, a row each, of the word shingles of `text` with A-Z in lower case; fewer words are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes split at space and tab to carriage return only
    n = len(words)
    if not n:
        return np.zeros((0, 8), np.uint8)
    line, k = b" ".join(words), min(shingle, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - k]))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist())]), np.uint8).reshape(-1, 8)


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash, as a signed number, of the word shingles of `text` with A-Z in lower case; 0 without words."""
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of shingle_hashes()."""
    if not len(hashes):
        return 0
    counts = np.bincount((hashes + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 4, seed: int = 42) -> DataFrame:
    """Add the SimHash of each whole text as a long (null and wordless texts: zero)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t or "", shingle, seed) for t in texts], dtype="int64")

    return docs.withColumn(out, of(F.col(text)))


def expected_work(n: int, segments: tuple[tuple[int, int], ...]) -> tuple[int, float]:
    """Keys that a fingerprint is looked up by, and pairs that each meets among `n` evenly spread ones."""
    balls = [(sum(math.comb(width, k) for k in range(radius + 1)), width) for width, radius in segments]
    return sum(ball for ball, _ in balls), n / 2 * sum(ball / 2**width for ball, width in balls)


def segments_for(n: int) -> tuple[tuple[int, int], ...]:
    """The segments of least work for `n` fingerprints: wider ones, with larger balls, as they grow more."""
    return min(SEGMENTS, key=lambda s: sum(expected_work(n, s)))


def _keys(fp: Column, segments: tuple[tuple[int, int], ...], around: bool) -> Column:
    """Keys of the segments of `fp`; with `around`, also of the ball about each, as (key, exact).

    A key is the segment's number above its value. Of two values that differ, only the one in which the highest
    differing bit is clear looks the other up, so that a pair meets once in a segment.
    """
    parts, low = [], 64
    for number, (width, radius) in enumerate(segments):
        low -= width
        value = F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1)
        key = value.bitwiseOR(F.lit(number << 32))
        parts.append(F.array(F.struct(key.alias("key"), F.lit(True).alias("exact"))))
        if around and radius:
            flips = [sum(1 << b for b in bits) for k in range(1, radius + 1) for bits in combinations(range(width), k)]
            tops = [1 << f.bit_length() - 1 for f in flips]
            ball = F.arrays_zip(F.array(*(F.lit(f).cast("long") for f in flips)).alias("flip"), F.array(*(F.lit(t).cast("long") for t in tops)).alias("top"))
            clear = F.filter(ball, lambda b: key.bitwiseAND(b["top"]) == 0)
            parts.append(F.transform(clear, lambda b: F.struct(key.bitwiseXOR(b["flip"]).alias("key"), F.lit(False).alias("exact"))))
    return F.concat(*parts)


def links(found: DataFrame, fp: str = "fingerprint", max_distance: int = MAX_DISTANCE, segments: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """Pairs (a, b) of different fingerprints at most `max_distance` bits apart, from a table of distinct ones.

    Every fingerprint probes the segment tables with the small Hamming ball about each of its segments; matches are
    verified over all 64 bits. A pair that meets in several segments comes once for each. Without `segments` the
    number of fingerprints chooses them; any choice finds the same pairs.
    """
    segments = segments or segments_for(found.count())
    assert sum(r + 1 for _, r in segments) > max_distance and sum(w for w, _ in segments) == 64
    keyed = lambda name, around: found.select(F.col(fp).alias(name), F.explode(_keys(F.col(fp), segments, around)).alias("s")).select(name, "s.*")
    probes, tables = keyed("a", True), keyed("b", False).drop("exact")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    return probes.join(tables, "key").filter((~F.col("exact") | (F.col("a") < F.col("b"))) & near).select("a", "b")


def _classes(rows: DataFrame, max_distance: int) -> DataFrame:
    """(fingerprint, root, component_id) for every fingerprint of (doc_id, fingerprint), by links between distinct ones.

    root is the least fingerprint of the component, component_id the least id of all its rows.
    """
    least = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "least")
    roots = connected_components(written(links(least, "fingerprint", max_distance).distinct(), "links"), "a", "b")
    joined = least.join(roots, least.fingerprint == roots.node, "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = joined.filter("node is not null").groupBy("root").agg(F.min("least").alias("smallest"))
    return joined.join(smallest, "root", "left").select("fingerprint", "root", F.coalesce("smallest", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Return doc_id, fingerprint (long) and component_id, the smallest id reachable over links, for every row.

    Equal fingerprints, zero included (null and empty texts), are linked without pairs: only distinct ones are
    searched. Rows with a null id take part; an id of null is returned only where no member has another. Repeated
    rows are returned as often as they occur, an empty table gives an empty one, and other columns of `docs` are left
    out, whatever their names. A very long text is held by one task with its shingles' hashes.
    """
    rows = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fingerprint", shingle, seed).drop("text"), "fingerprints")
    return rows.join(_classes(rows, max_distance), "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def clustered(docs: DataFrame, text: str = "text", out: str = "cluster", shingle: int = 4, seed: int = 42, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Replace the text of every row by `out`, a number that the rows of one group of near-duplicates share.

    Null and empty texts are one group, repeated rows are in one; an empty table gives an empty one. Other columns keep
    their names, whatever these are; one named `out` is replaced.
    """
    names = [c for c in docs.columns if c not in (text, out)]
    rest = F.struct(F.lit(0).alias("row"), F.struct(*(F.col("docs").getField(c).alias(c) for c in names)).alias("of")) if names else F.struct(F.lit(0).alias("row"))
    rows = held(docs, text=F.col(text), row=F.monotonically_increasing_id()).select(rest.alias("rest"), "row", "text")
    rows = written(fingerprints(rows, "text", "fingerprint", shingle, seed).drop("text"), "fingerprints")
    classes = _classes(rows.select(F.col("row").alias("doc_id"), "fingerprint"), max_distance)
    met = rows.join(classes.select("fingerprint", "component_id"), "fingerprint")
    return met.select(*(F.col("rest.of").getField(c).alias(c) for c in names), F.col("component_id").alias(out))
