"""Centroids, the filter audit and the Jaccard join against plain versions."""

import hashlib
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import audit, lloyd, partenum, queries

from .test_text_operators import ODD, with_clashes

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_clusters(rows, k=8, rounds=10, dims=64):
    """(id, cluster, distance, cluster inertia, inertia, centroid hash) in Python's integers, row by row."""
    kept = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    c = [v for _, _, v in sorted((sha(f"3:{'' if i is None else i}"), v, v) for i, v in kept)[:k]]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[far(v)[1]].append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j])] if of[j] else m for j, m in enumerate(c)]
    out = [(i, far(v)[1], far(v)[0]) for i, v in kept]
    inertia = defaultdict(int)
    for _, j, d in out:
        inertia[j] += d
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), sha(",".join(map(str, c[j])))) for i, j, d in out)


def test_centroids_equal_a_plain_version(spark):
    rng = np.random.default_rng(4)
    vector = lambda scale=1.0: [float(x) for x in rng.normal(0, scale, 64)]
    hot = vector()
    rows = [(i, vector()) for i in range(60)] + [(100 + i, hot) for i in range(40)] + [(7, hot), (7, hot), (7, vector()), (None, vector()), (None, hot)]
    odd = [(300, None), (301, hot[:63]), (302, hot + [0.0]), (303, [None, *hot[1:]]), (304, [float("nan"), *hot[1:]]), (305, [float("inf"), *hot[1:]]), (306, [])]
    told = lambda df: sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())
    schema = "vec_id long, embedding array<double>"
    got = lloyd.clusters(spark.createDataFrame(rows + odd, schema).repartition(5).withColumn("cluster", F.lit("clash")).withColumn("weight", F.lit(3)))
    assert told(got) == plain_clusters(rows + odd) and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = [(1, hot), (2, hot), (2, hot)]  # fewer rows than centroids, all alike
    assert told(lloyd.clusters(spark.createDataFrame(few, schema))) == plain_clusters(few)
    for scale in (1e4, 1e5):  # distances beyond doubles, and beyond what longs can multiply
        wide = [(i, vector(scale)) for i in range(20)]
        assert told(lloyd.clusters(spark.createDataFrame(wide, schema))) == plain_clusters(wide)
    for none in ([], odd):
        assert lloyd.clusters(spark.createDataFrame(none, schema)).collect() == []
    far = told(lloyd.clusters(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, hot)], schema), k=1))
    assert sorted(r[2] for r in far)[1:] == [lloyd.MOST] * 2


@pytest.mark.parametrize("size", [50, 1 << 22, 1 << 40])
def test_distances_are_exact(size):
    rng = np.random.default_rng(size)
    rows, centroids = rng.integers(-size, size, (30, 64)), rng.integers(-size, size, (8, 64))
    best, far = lloyd.nearest(rows, centroids)
    for row, j, d in zip(rows.tolist(), best, far):
        assert (d, j) == min((sum((a - b) ** 2 for a, b in zip(row, c)), i) for i, c in enumerate(centroids.tolist()))


def plain_audit(docs, labels):
    least, good, toxic = {}, defaultdict(bool), defaultdict(bool)
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good[i] |= q == 1
        toxic[i] |= x == 1
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = dict(A=len(w) < 100, B=100 * len(set(w)) < 80 * len(w), C=100 * len(re.findall("[A-Z]", t)) > 10 * len(t), D=bool(re.search(r"[#$%&*|]", t)), E=i is not None and t in least and least[t] < i)
        rows.append((lang or "", fails, i is not None and good[i], i is not None and toxic[i]))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                here, redundant = [r for r in left if r[1][f]], sum(r[1][f] and any(r[1][g] for g in order[: step - 1]) for r in rows if r[0] == part)
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), redundant, sum(r[1][f] and sum(r[1].values()) == 1 for r in rows if r[0] == part), sum(r[2] for r in here), sum(r[3] for r in here), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_equals_every_order(spark):
    words = " ".join(f"w{k}" for k in range(120))
    texts = [*ODD, words, words, words + " #", "AB " * 200, words.upper(), words + " w1" * 60, "# " + "A B " * 100]
    docs = [(i % 9 if i % 9 else None, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts * 2)] + [(5, words, "en")] * 3
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (None, 1, 1), (5, 1, 1), (8, 0, 0)]
    frame = with_clashes(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)).withColumn("mask", F.lit("clash"))
    got = audit.interaction_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert found == plain_audit(docs, labels) and len(found) == 3 * 600 == got.count()
    assert audit.interaction_audit(frame.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def plain_join(rows, shingle=3, percent=90):
    sets, copies = {}, defaultdict(list)
    for at, (_, t) in enumerate(rows):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[at] = frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset()
        copies[sets[at]].append(at)
    root = {at: copies[s][0] if s else at for at, s in sets.items()}
    firsts = [v[0] for s, v in copies.items() if s]
    for a in firsts:
        for b in firsts:
            if a < b and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: x if r == y else r for k, r in root.items()}
    ids = defaultdict(list)
    for at, r in root.items():
        if rows[at][0] is not None:
            ids[r].append(rows[at][0])
    return sorted((str(rows[at][0]), len(sets[at]), str(min(ids[r]) if sets[at] and ids[r] else rows[at][0])) for at, r in root.items())


def edited(rng, words, changes):
    other = list(words)
    for at in rng.choice(len(other), changes, replace=False):
        other[at] = f"new{rng.integers(1 << 40)}"
    return other


def test_jaccard_join_equals_brute_force(spark):
    rng = np.random.default_rng(13)
    vocab, shared = [f"w{k}" for k in range(700)], [f"common{k}" for k in range(60)]
    texts = [*ODD, "One two", "one TWO", "a b c", "A  b\tc"]
    for g in range(40):  # from 5 to 400 words, with and without a passage that many share, edited up to and beyond the limit
        words = [str(x) for x in rng.choice(vocab, 5 + g * 10)] + (shared if g % 2 else [])
        texts += [" ".join(edited(rng, words, min(len(words), c))) for c in (0, 0, 1, 2, 3, 5) if c <= max(2, len(words) // 40)]
        texts += [" ".join(words[: len(words) - len(words) // 12]), " ".join(words[1:])]
    hot = shared * 2 + [f"g{k}" for k in range(100)]
    texts += [" ".join(edited(rng, hot, 3)) for _ in range(50)] + [" ".join(hot)]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, "k l m n o p"), (3, "k l m n o p"), (3, "other words of this id"), (None, "k l m n o p q")]
    frame = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.rand(3))).withColumn("node", F.lit("clash"))
    told = lambda df: sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())
    assert told(partenum.jaccard_join(frame)) == plain_join(rows)
    some = rows[:120]
    assert told(partenum.jaccard_join(spark.createDataFrame(some, "doc_id long, text string"), shingle=2, percent=80)) == plain_join(some, 2, 80)
    assert partenum.jaccard_join(frame.limit(0)).collect() == []
    assert [r.component_id for r in partenum.jaccard_join(spark.createDataFrame([("b", "x y z"), ("a", "x Y z")], "doc_id string, text string")).collect()] == ["a", "a"]


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(-(1 << 63), (1 << 63) - 1, n)
    met = apart = 0
    for percent in (90, 80):
        for n in [*range(1, 60), 75, 100, 140, 333, 1000, 4000]:
            for _ in range(12):
                a = np.unique(draw(n))
                gone, new = sorted(rng.integers(0, 2 + n * (100 - percent) // 100, 2))
                b = np.unique(np.append(rng.permutation(a)[gone:], draw(new)))
                if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                    met += 1
                    assert len(np.intersect1d(partenum.signatures(a, percent), partenum.signatures(b, percent)))
                other = partenum.signatures(np.unique(draw(n)), percent)
                apart += percent == 90 and len(np.intersect1d(partenum.signatures(a, percent), other)) > 0
    assert met > 500 and apart == 0  # unrelated sets do not meet
    assert len(partenum.signatures(np.zeros(0, np.int64))) == 0


def test_bands_and_schemes():
    for percent in (90, 80, 95):
        lo, hi = partenum.bands(percent)
        assert all(a + 1 == b for a, b in zip(hi, lo[1:]))
        for size in range(lo[0], 5000, 7):
            band = next(i for i, h in enumerate(hi) if size <= h)
            assert size * 100 // percent <= hi[band + 1]  # a similar set is in this band or the next
        for number in range(60):
            parts, pieces, k, spare, subsets = partenum.scheme(percent, number)
            left_out = pieces - subsets.shape[1]
            assert parts - k // (left_out + 1) == 1 + spare  # so many parts differ in no more pieces than a subset leaves out


def test_whole_queries(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_jaccard_join"](spark, DIR).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == plain_join([tuple(r) for r in docs])
