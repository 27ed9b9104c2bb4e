"""Operator 13, n-gram Jaccard join: PartEnum signatures of size bands, verified over whole shingle sets."""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .similar import bitmap, by_slices, joined, longs, shingle_set

#: Words of a shingle, and the least similarity of linked sets in percent.
SHINGLE, PERCENT = 3, 90
#: Ways to enumerate a first-level part: pieces that it has, and how many of them may differ.
WAYS = ((1, 0), (3, 1), (4, 1), (5, 2))
#: Shingles that a signature of the smallest set of its band is expected to cover at least, where a way does; fewest
#: that make a signature; and for how many differing shingles there is one more part than needed, besides a first one,
#: so that a set may lose as many thinner signatures.
EXPECTED, THIN, SPARE = 7, 3, 20
#: Sets are of fewer shingles than this.
LARGEST = 1 << 40
#: Rounds that compare each set with one or two others of its buckets, of most shared signatures and drawn, before all pairs.
STARS, DRAWS = 1, 2


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit numbers (multiply and shift)."""
    x = (values + np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x8EBC6AF09C88C6E3)
    return x ^ (x >> np.uint64(29))


@lru_cache
def bands(percent: int) -> tuple[list[int], list[int]]:
    """Least and largest set sizes of the bands: two sets of similarity `percent` or more are in one band or in
    neighbouring ones. Below the first band only equal sets are that similar."""
    lo, hi = [-(-percent // (100 - percent))], []
    while True:
        hi.append(lo[-1] * 100 // percent)
        if hi[-1] >= LARGEST:
            return lo, hi
        lo.append(hi[-1] + 1)


@lru_cache
def scheme(percent: int, number: int) -> tuple[int, int, int, int, np.ndarray]:
    """How the sets of band `number`, and those of the band below that may match them, are cut: first-level parts,
    pieces of a part, shingles that similar sets differ in at most, parts to spare, and the subsets of pieces that make
    a signature each.

    Two sets of at most hi shingles differ in k = 2 hi (100 - percent) / (100 + percent) at most. So of k / (differ + 1)
    + 1 + spare parts at least 1 + spare differ in `differ` shingles at most, and of a part cut into more pieces than
    that some subset without the differing ones is the same in both. Of the ways that cover enough shingles the one
    with the fewest signatures is taken.
    """
    lo, hi = bands(percent)
    k, least = 2 * hi[number] * (100 - percent) // (100 + percent), lo[max(0, number - 1)]
    ways, spare = [], 1 + k // SPARE
    for pieces, differ in WAYS:
        parts = k // (differ + 1) + 1 + spare
        covered, signatures = least * (pieces - differ) / (pieces * parts), parts * comb(pieces, differ)
        ways.append((covered < EXPECTED, signatures if covered >= EXPECTED else -covered, parts, pieces, differ))
    _, _, parts, pieces, differ = min(ways)
    return parts, pieces, k, spare, np.array(list(combinations(range(pieces), pieces - differ)))


@lru_cache(maxsize=1024)
def bounds(pieces: int) -> np.ndarray:
    """First hashes of all pieces but the first, of even ranges of the unsigned 64-bit numbers."""
    return np.array([(i << 64) // pieces for i in range(1, pieces)], np.uint64)


def _cut(hashes: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the scrambled hashes in each piece, and their number; `hashes` are unsigned and sorted."""
    at = np.concatenate(([0], np.searchsorted(hashes, bounds(pieces)), [len(hashes)]))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes), dtype=np.uint64)))
    return sums[at[1:]] - sums[at[:-1]], np.diff(at)


def signatures(found: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """PartEnum signatures of a sorted set of hashes, as longs: two sets of similarity `percent` or more share one.

    A set signs for its own band and for the next one, with the projections of the domain's enumerated pieces. A
    projection of fewer than THIN shingles is the same in many sets. Similar sets share 1 + spare signatures, so a set
    with at most `spare` thin ones goes without them. With more, each thin one is joined to every part of a second,
    independent partition into k + 1: of two similar sets that are alike in it one such part is alike, too.
    """
    n, (lo, hi) = len(found), bands(percent)
    if not n:
        return np.zeros(0, np.int64)
    hashes = np.sort(found.view(np.uint64))
    if n < lo[0]:  # similar to equal sets only
        return mixed(_cut(hashes, 1)[0] + np.uint64(n)).view(np.int64)
    out, band = [], bisect_left(hi, n)
    for number in (band, band + 1):
        parts, pieces, k, spare, subsets = scheme(percent, number)
        sums, counts = _cut(hashes, parts * pieces)
        projected = sums.reshape(parts, pieces)[:, subsets].sum(2, dtype=np.uint64).ravel()
        covered = counts.reshape(parts, pieces)[:, subsets].sum(2).ravel()
        keys = mixed(projected ^ mixed(np.arange(len(projected), dtype=np.uint64) + np.uint64(number << 40)))
        thin = covered < THIN
        out.append(keys[~thin])
        if thin.sum() > spare:
            second = _cut(np.sort(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))), k + 1)[0]
            second = mixed(second + np.arange(k + 1, dtype=np.uint64))
            out.append(mixed(keys[thin][:, None] ^ second[None, :]).ravel())
    return np.unique(np.concatenate(out)).view(np.int64)


def _signed(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, of, row) with n, digest, bits and keys of the text, which comes last."""
    return by_slices(rows, "n int, digest binary, bits array<long>, keys array<long>", lambda texts: _columns([shingle_set(t, shingle) for t in texts], percent))


def _columns(sets: list[np.ndarray], percent: int) -> list[pa.Array]:
    return [pa.array([len(s) for s in sets], pa.int32()), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), longs([bitmap(s) for s in sets]), longs([signatures(s, percent) for s in sets])]


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Return doc_id, n_shingles and component_id, the smallest id reachable over links, for every row.

    Two texts are linked if the sets of their word shingles (A-Z in lower case; fewer words than a shingle are one)
    have Jaccard similarity of `percent` or more; all pairs that share a signature are verified on whole sets, so none
    is missed and none is wrong. Texts without words, null included, are linked with nothing: their component is
    their own id. Equal sets are one node, so copies cost one row each. Rows with a null id take part; a component_id
    is null only where no member has an id. Repeated rows come back as often as they occur, an empty table gives an
    empty one, and other columns are left out, whatever their names. A very long text is held by one task with its
    shingles' hashes.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = named.select("doc_id", F.coalesce(F.md5("text"), F.lit("")).alias("of"), "text")
    rows = written(_signed(named.select("doc_id", "of", F.monotonically_increasing_id().alias("row"), "text"), shingle, percent), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    sets = written(rows.filter("n > 0").groupBy("n", "digest").agg(first, F.min(F.struct("row", "of")).alias("node")).select("n", "digest", "first", "node.*"), "sets")
    copies = written(rows.filter("n > 0").select("row").join(sets.select("row"), "row", "left_anti"), "copies")  # few, or as long as the table
    signed = rows.filter("n > 0").join(copies, "row", "left_anti").select(F.col("row").alias("node"), "n", "bits", "keys")
    nodes = written(signed.drop("keys"), "nodes")

    def sets_of(asked: DataFrame) -> DataFrame:
        """(node, set) of the nodes asked for: their texts are looked up by MD5 and cut into shingles again."""
        wanted = asked.join(sets.select(F.col("row").alias("node"), "of"), "node")
        texts = named.select("of", "text").join(wanted.select("of"), "of", "left_semi").dropDuplicates(["of"])
        return by_slices(texts.join(wanted, "of").select("node", "text"), "set array<long>", lambda values: [longs([shingle_set(t, shingle) for t in values])])

    entries = signed.select("node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    live = written(entries.join(shared, "key", "left_semi"), "buckets")
    roots = joined(nodes, live, None, sets_of, percent / 100, STARS, DRAWS)
    of = sets.join(roots.withColumnRenamed("node", "_node"), F.col("row") == F.col("_node"), "left").select("n", "digest", "first", F.coalesce("root", "row").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("least"))
    found = of.join(least, "root").select(F.col("n").alias("_n"), F.col("digest").alias("_digest"), F.col("least.doc_id").alias("least"))
    met = rows.select("doc_id", "n", "digest").join(found, (F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_digest")), "left")
    return met.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
