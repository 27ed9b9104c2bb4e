"""Exact similarity behind operator 4: candidates of fingerprints and of shingle signatures, verified by their sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import among, drop_written, held, released, without, written
from .components import connected_components
from .simhash import fingerprint_of, links, shingle_hashes

#: Words of a shingle, and the least similarity of linked texts.
SHINGLE, LEAST = 5, 0.8
#: Texts that the order of shingles is learnt from: this share of them, or this many if that is more, so that what
#: counts as common doesn't change with the table's size. And the most shingles in the order, 16 bytes each. The order
#: only makes buckets small: whatever it is, two texts of similarity LEAST share a shingle of their prefixes.
SAMPLE, SHARE, COMMON = 1 << 11, 0.1, 1 << 19
#: Rounds that compare each text with one or two that it meets: first with the one of most shared keys, then with two of
#: those that can be similar, out of NEXT that are drawn in each bucket. All pairs of what is still apart come after them.
STARS, DRAWS, NEXT = 1, 1, 4
#: Pairs of one text that are compared in one task, and texts whose sets a worker hands on at once.
FAN, SLICE = 64, 512
#: Longs of the bitmaps, and the least keys of a text's own, that go with every entry of a bucket.
SMALL, LOW = 8, 8


def shingle_set(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text (none without words)."""
    return np.unique(shingle_hashes(text or "", shingle, seed).reshape(-1).view(np.int64))


def prefix(found: np.ndarray, order: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The shingles of a set that come first in the order, in which rare ones precede common ones.

    Of n shingles a set of similarity `least` or more shares ceil(least * n), so one of the n - ceil(least * n) + 1
    that come first in any order that all texts have in common.
    """
    known, count = order
    often = np.zeros(len(found), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        often = np.where(known[at] == found, count[at], 0)
    return found[np.argsort(often, kind="stable")][: len(found) - math.ceil(least * len(found) - 1e-9) + 1] if len(found) else found


def bitmap(found: np.ndarray) -> np.ndarray:
    """Longs whose bits tell whether an odd number of shingles falls there; two bits or more for each shingle."""
    size = max(64, 1 << (2 * max(1, len(found)) - 1).bit_length())
    odd = np.bincount(found & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two or more sampled texts hold, sorted, and in how many: the COMMON most frequent ones."""
    share = max(SHARE, min(1.0, SAMPLE / max(1, texts.count())))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                yield pd.DataFrame({"h": np.concatenate([shingle_set(t, shingle) for t in batch["text"].iloc[a : a + 256]])})

    drawn = texts.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = drawn.select("text").mapInPandas(hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()  # two numbers a shingle: a row of Python objects would be ten times that
    h, n = (found.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(h)
    return h[order], n[order]


def longs(arrays: list[np.ndarray]) -> pa.Array:
    """A column of lists of longs."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def by_slices(rows: DataFrame, added: str, of: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    """`rows` with the columns `added` that `of` gives for their text, in its place. SLICE rows at a time leave a task,
    so that a worker holds few of them at once."""
    kept = [f for f in rows.schema if f.name != "text"]
    new = StructType.fromDDL(added)
    names = [f.name for f in [*kept, *new.fields]]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *of(part.column("text").to_pylist())], names=names)

    return rows.mapInArrow(slices, StructType([*kept, *new.fields]))


def _signed(rows: DataFrame, shingle: int, least: float, order) -> DataFrame:
    """`rows` with n, digest, fingerprint, prefix and bits in place of the text."""

    def sign(texts: list[str | None]) -> list[pa.Array]:
        hashes = [shingle_hashes(t or "", shingle, 42) for t in texts]
        sets = [np.unique(h.reshape(-1).view(np.int64)) for h in hashes]
        return [
            pa.array([len(s) for s in sets], pa.int32()), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
            pa.array([fingerprint_of(h) for h in hashes], pa.int64()), longs([prefix(s, order.value, least) for s in sets]), longs([bitmap(s) for s in sets]),
        ]

    return by_slices(rows, "n int, digest binary, fingerprint long, prefix array<long>, bits array<long>", sign)


def _fit(least: float, a: tuple[Column, Column] | None = None, b: tuple[Column, Column] | None = None) -> Column:
    """Whether the sizes and bitmaps of a and b allow similarity `least`: each bit that differs is a shingle of one
    text only. The bitmap of the larger text may be longer; its parts are put over each other first."""
    (n_a, bits_a), (n_b, bits_b) = a or (F.col("n_a"), F.col("bits_a")), b or (F.col("n_b"), F.col("bits_b"))
    m = F.least(F.size(bits_a), F.size(bits_b))
    folded = lambda c: F.when(F.size(c) > m, F.zip_with(F.slice(c, F.lit(1), m), F.slice(c, m + 1, m), lambda p, q: p.bitwiseXOR(q))).otherwise(c)
    differ = F.aggregate(F.zip_with(folded(bits_a), folded(bits_b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    sizes = F.least(n_a, n_b) >= least * F.greatest(n_a, n_b) - 1e-9
    return sizes & (differ <= (n_a + n_b) * ((1 - least) / (1 + least)) + 1e-9)


def _ends(pairs: DataFrame) -> DataFrame:
    """(node): both ends of every pair, as often as they occur."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _possible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs whose sizes and bitmaps allow similarity `least`, written. What is known of their ends is written, too,
    so that a plan looks it up for both ends but finds it once."""
    met = written(among(nodes.select("node", "n", "bits"), _ends(pairs), "node"), "ends")
    x, y = (met.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    out = written(pairs.join(x, "a").join(y, "b").filter(_fit(least)).select("a", "b"), "pairs")
    drop_written(met)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """The pairs whose sets have Jaccard similarity `least` or more.

    Only texts of pairs that are possible at all are read and cut into shingles. The set of a text in many pairs is
    dealt to many tasks.
    """
    met = written(pairs, "met")
    pairs = _possible(met, nodes, least)
    asked = written(_ends(pairs).distinct(), "asked")
    sets = written(sets_of(asked), "sets")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    left = sets.join(parts, sets.node == parts.a).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("set").alias("x"))
    both = dealt.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").join(left, ["a", "part"])
    common = F.size(F.array_intersect("x", "y"))
    near = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total")).filter(F.col("common") >= least * (F.col("total") - F.col("common")) - 1e-9)
    out = written(near.select("a", "b"), "links")
    for used in (met, pairs, asked, sets):
        drop_written(used)
    return out


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by operator 4's search: fingerprints within its distance, and texts of one fingerprint."""
    firsts = written(nodes.groupBy("fingerprint").agg(F.min("node").alias("node")), "fingerprints")
    same = nodes.select("fingerprint", F.col("node").alias("b")).join(firsts.withColumnRenamed("node", "a"), "fingerprint").filter("a <> b").select("a", "b")
    x, y = (firsts.select(F.col("fingerprint").alias(f"f{c}"), F.col("node").alias(c)) for c in "ab")
    near = links(firsts).distinct().toDF("fa", "fb").join(x, "fa").join(y, "fb").select("a", "b")
    return same.unionByName(near)


def _apart(live: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root): members of the buckets that hold more than one component as they are now."""
    now = live.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    key = Window.partitionBy("key")
    return now.withColumns({"lo": F.min("root").over(key), "hi": F.max("root").over(key)}).filter("lo < hi").select("key", "node", "root")


def _star(live: DataFrame, number: int) -> DataFrame:
    """A pair for each text that is apart from one that it meets: the one with the most keys that others have, too.

    Of a text and its edited copies that is the text itself, as an edit's shingles are its own. Ties go by hash.
    """
    keys = live.groupBy("node").agg((-F.count("*")).alias("fewer"))
    order = F.struct("fewer", F.xxhash64("node", F.lit(number)).alias("h"), "node", "root")
    pivots = live.join(keys, "node").groupBy("key").agg(F.min(order).alias("p")).select("key", "p")
    met = live.join(pivots, "key").filter("root <> p.root").groupBy("node").agg(F.min("p").alias("p"))
    return met.select(F.col("p.node").alias("a"), F.col("node").alias("b"))


def _drawn(live: DataFrame, nodes: DataFrame, least: float, number: int) -> DataFrame:
    """Two pairs at most for each text, with texts that are apart from it and whose sizes and small bitmaps can be similar.

    Each bucket is put in an order of its own, by hash, and an entry looks at the NEXT ones behind it. Similar texts
    share many buckets, so that a text which many are similar to meets some of them; two links each make a group of
    which many are similar to many one component, or nearly so, whichever texts are drawn.
    """
    order = Window.partitionBy("key").orderBy(F.xxhash64("node", "key", F.lit(number)), "node")
    told = _told(live, nodes).withColumns({f"x{i}": F.lead(F.struct("node", "root", "n", "bits"), i + 1).over(order) for i in range(NEXT)})
    x = [F.col(f"x{i}") for i in range(NEXT)]
    fits = [(c["root"] != F.col("root")) & _fit(least, (F.col("n"), F.col("bits")), (c["n"], c["bits"])) for c in x]
    found = told.select("node", F.coalesce(*(F.when(f, c["node"]) for f, c in zip(fits, x, strict=True))).alias("other")).filter("other is not null")
    by_hash = F.struct(F.xxhash64("node", "other", F.lit(number)).alias("h"), "other")
    two = found.groupBy("node").agg(F.min(by_hash).alias("p"), F.max(by_hash).alias("q"))
    pairs = two.select("node", F.explode(F.array("p.other", "q.other")).alias("other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _small(bits: Column) -> Column:
    """A bitmap's parts of SMALL longs put over each other: it still never differs in more bits than shingles do."""
    at = lambda i: F.filter(bits, lambda _, k: k % SMALL == i)
    return F.when(F.size(bits) <= SMALL, bits).otherwise(F.transform(F.sequence(F.lit(0), F.lit(SMALL - 1)), lambda i: F.aggregate(at(i), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))))


def _told(live: DataFrame, nodes: DataFrame) -> DataFrame:
    """The entries of buckets with sizes and small bitmaps of their nodes."""
    return live.join(among(nodes.select("node", "n", _small(F.col("bits")).alias("bits")), live.select("node"), "node"), "node")


def _all_apart(live: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs of a bucket's members that are still apart and whose sizes and small bitmaps can be similar.

    A pair meets in all keys that both have. With each text go its LOW least keys, by rank: a pair that has some of
    these in common comes from the least of them alone, any other pair from all. The entries with what goes with them
    are written, as the join reads them from both sides.
    """
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("key"), "key"))
    low = live.select("node", "key", rank.alias("rank")).filter(F.col("rank") <= LOW).groupBy("node").agg(F.collect_list("key").alias("low"))
    told = written(_told(live, nodes).join(low, "node"), "told")
    x, y = (told.select(F.col("key").alias(f"key_{c}"), F.col("node").alias(c), *(F.col(v).alias(f"{v}_{c}") for v in ("n", "bits", "root", "low"))) for c in "ab")
    apart = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))
    once = F.coalesce(F.array_min(F.array_intersect("low_a", "low_b")), F.col("key_a")) == F.col("key_a")
    return x.join(y, (F.col("key_a") == F.col("key_b")) & apart & _fit(least) & once).select("a", "b").distinct()


def joined(nodes: DataFrame, live: DataFrame, edges: DataFrame | None, sets_of: Callable[[DataFrame], DataFrame], least: float, stars: int | None = None, draws: int | None = None) -> DataFrame:
    """(node, root) of every node with a link, from the entries (key, node) of buckets in which similar nodes meet.

    `edges` are links known before. Round by round every node is compared with one or two of those that it meets, so
    that a large group of copies costs a few comparisons for each, then with all of its buckets that are still apart
    from it. `stars` and `draws` are the rounds before that, STARS and DRAWS by default.
    """
    stars, draws = STARS if stars is None else stars, DRAWS if draws is None else draws
    edges = written(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), "edges") if edges is None else edges
    roots = connected_components(edges, "a", "b")
    for number in range(stars + draws + 1):
        left = written(_apart(live, roots), "buckets")
        drop_written(live)
        live = left
        if live.isEmpty():
            break
        pairs = _star(live, number) if number < stars else _drawn(live, nodes, least, number) if number < stars + draws else _all_apart(live, nodes, least)
        found = _verified(pairs, nodes, sets_of, least)
        both = written(edges.unionByName(found), "edges")
        drop_written(edges)
        edges = both
        roots = connected_components(edges, "a", "b")
    return roots


def _components(nodes: DataFrame, rows: DataFrame, text: Column, shingle: int, least: float) -> DataFrame:
    """(node, root) of every node with a link: pairs of operator 4's fingerprints first, then those that share a
    shingle of their prefixes."""

    def sets_of(asked: DataFrame) -> DataFrame:
        texts = among(rows.select(F.col("row").alias("node"), text.alias("text")), asked, "node")
        return by_slices(texts, "set array<long>", lambda values: [longs([shingle_set(t, shingle) for t in values])])

    edges = _verified(_by_fingerprint(nodes), nodes, sets_of, least)
    entries = nodes.select("node", F.explode("prefix").alias("key"))
    return joined(nodes, written(_shared(entries), "buckets"), edges, sets_of, least)


def _shared(entries: DataFrame) -> DataFrame:
    """The entries (key, node) of keys that several nodes have; one exchange, a key's entries are held by one task that
    spills."""
    key = Window.partitionBy("key")
    told = entries.withColumns({"lo": F.min("node").over(key), "hi": F.max("node").over(key)})
    return told.filter("lo < hi").select("key", "node")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row of each group of near-duplicates with all columns of `docs`: the smallest id, of equal ids any one.

    Two texts are linked if the sets of their word shingles have Jaccard similarity `least` or more (texts of fewer
    words than a shingle are one shingle, texts without words, null included, are copies of each other); groups are
    the components. No pair is missed and every link is verified on whole sets: candidates are operator 4's
    fingerprint pairs, and, as 64 bits can't reach down to 0.8, texts that share a shingle of their prefixes. Rows
    with a null id stay only where their group has no other; repeated rows are copies; an empty table gives an empty
    one. A very long text is held by one task. Columns keep their names, whatever these are. Texts are written once;
    they are shuffled only where the ids to look up or to drop are too many to broadcast.
    """
    bare = written(held(docs, row=F.monotonically_increasing_id()), "texts")
    value = F.col("docs").getField(text)
    order = docs.sparkSession.sparkContext.broadcast(_common(bare.select("row", value.alias("text")), shingle))
    rows = written(_signed(bare.select(F.col("docs").getField(doc_id).alias("doc_id"), "row", value.alias("text")), shingle, least, order), "signed")
    order.destroy()  # megabytes that nothing needs any more
    ordered = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    sets = written(rows.groupBy("n", "digest").agg(F.min(ordered).alias("first")).select("first"), "sets")
    copies = written(rows.select("row").join(sets.select("first.row"), "row", "left_anti"), "copies")  # few, or as long as the table
    nodes = written(without(rows.select(F.col("row").alias("node"), "n", "fingerprint", "prefix", "bits"), copies.withColumnRenamed("row", "node"), "node"), "nodes")
    drop_written(rows)
    roots = _components(nodes, bare, value, shingle, least)
    of = sets.join(roots, F.col("first.row") == F.col("node"), "left").groupBy(F.coalesce("root", "first.row").alias("root")).agg(F.min("first").alias("first"))
    gone = written(bare.select("row").join(of.select(F.col("first.row").alias("row")), "row", "left_anti"), "gone")
    return released(without(bare, gone, "row"))
