"""Hand-computed values of the operators, and the queries against their SQL."""

import math
import random
import re
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylight.functions import identity, vector
from quarrylight.functions import text as tx
from quarrylight.operators import calendar, entities, filters, reports, scoring, search, telemetry
from quarrylight.operators import postings as index
from quarrylight.plans import registry
from quarrylight.sources import documents as files
from quarrylight.streaming import stateful

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def clock():
    return F.lit("2026-09-28").cast("timestamp")



def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(df):
    def cell(v):
        if not isinstance(v, (list, dict)) and pd.isna(v):
            return ""
        if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
            return f"{float(v):.9g}"
        return str(v).removesuffix(" 00:00:00")

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DIR).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numbers = [c for c in got.columns if pd.api.types.is_numeric_dtype(want[c]) and not pd.api.types.is_bool_dtype(want[c])]
    for c in numbers:
        got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert plain(got) == plain(want)


def matches(spark, rows):
    return spark.createDataFrame(rows, "profile string, version string, number int, dense double, lexical double, skills array<string>, years double, submitted timestamp, category string")


def test_ranker_blends_and_prefers_later_versions(spark):
    day = datetime(2026, 9, 28)
    rows = [("p", "v1", 1, 0.6, 1.0, ["a"], 4.0, day, None), ("p", "v2", 2, 0.6, 1.0, ["a"], 4.0, day, None), ("q", "w1", 1, 1.0, None, ["a", "b"], 0.0, None, "X")]
    got = {r.profile: r for r in search.rank_versions(matches(spark, rows), clock(), 10).collect()}
    assert math.isclose(got["p"].c_semantic, 0.84) and got["p"].version == "v2" and got["p"].others == ["v1"]
    assert got["p"].score == round(100 * (0.5 * 0.84 + 0.05) / 0.55, 2)
    assert got["q"].score == round(100 * 0.5 / 0.55, 2) and got["q"].c_freshness == 0
    full = {r.profile: r for r in search.rank_versions(matches(spark, rows), clock(), 10, required=["a", "b"], preferred=["c"], minimum_experience=2, category="X").collect()}
    assert full["p"].c_required == 0.5 and full["p"].c_preferred == 0 and full["p"].c_experience == 1 and full["p"].c_category == 0.5 and full["q"].c_category == 1
    assert [r.profile for r in search.rank_versions(matches(spark, rows), clock(), 10, required=["a", "b"], hard_required=True).collect()] == ["q"]
    with pytest.raises(ValueError):
        search.rank_versions(matches(spark, rows), clock(), 10, weights={"semantic": 0.5, "freshness": 0.4})


def test_rerank_touches_the_head_only(spark):
    ranked = spark.createDataFrame([("a", 1, 90.0), ("b", 1, 80.0), ("c", 1, 70.0)], "profile string, number int, score double")
    scores = spark.createDataFrame([("a", 0.0), ("b", 1.5), ("c", 1.0)], "profile string, rerank double")
    assert [(r.profile, r.score) for r in search.rerank_blend(ranked, scores, 3, head=2).collect()] == [("b", 94.0), ("a", 27.0), ("c", 70.0)]


def test_results_longer_than_a_page_stay_whole(spark):
    ranked = spark.range(3000).select(F.col("id").cast("string").alias("profile"), F.lit(1).alias("number"), (F.col("id") % 977 / 10).alias("score"))
    scores = ranked.select("profile", F.lit(1.0).alias("rerank"))
    out = search.rerank_blend(ranked, scores, 2000, head=20).collect()
    want = [r.profile for r in ranked.orderBy(F.desc("score"), F.desc("number"), "profile").limit(2000).collect()]
    assert [r.profile for r in out[20:]] == want[20:] and sorted(r.profile for r in out[:20]) == sorted(want[:20])
    assert search.result_rows(ranked, F.lit(1), F.lit("q")).count() == 3000
    placed = search.warehouse_rerank(ranked.withColumnRenamed("profile", "cv"), scores.withColumnRenamed("profile", "cv"))
    assert sorted(r.place for r in placed.collect()) == list(range(1, 3001))


def test_hits_and_fallbacks(spark):
    rows = [(1, "READY", [1.0, 0.0], "alpha line\nlast Beta"), (2, "READY", [0.0, 1.0], "nothing"), (3, "STALE", [1.0, 0.0], "none\nalpha beta"), (4, "READY", None, "alphabet"), (5, "READY", [1.0, 1.0], None)]
    versions = spark.createDataFrame(rows, "version int, status string, vector array<double>, document string")
    hits = [(1, 10, 0.5, 0.0, "c10"), (1, 11, None, 1.0, "c11"), (2, 20, None, 0.5, "c20"), (3, 30, None, 0.5, "c30"), (4, 40, None, 0.1, "c40")]
    page = search.page_of(spark.createDataFrame(hits, "version int, chunk int, dense double, lexical double, chunk_text string"), 5)
    told = lambda *a: {r.version: (r.level, round(r.dense, 6), r.lexical, r.method, r.evidence) for r in search.chained_matches(versions, *a).collect()}
    assert told(page, [1.0, 0.0], ["alpha", "beta"]) == {
        1: ("CHUNK", 0.5, 0.0, "SEMANTIC_CHUNK", "c10"), 2: ("DOCUMENT", 0.0, 0.0, "LEXICAL_CHUNK", "c20"), 3: ("OVERLAP", 1.0, 1.0, "LEXICAL_CHUNK", "c30"), 4: ("OVERLAP", -1.0, 0.0, "LEXICAL_CHUNK", "c40"),
    }  # the version without a hit is left out
    none = search.page_of(page.limit(0), 0)
    assert told(none, None, ["alpha", "beta"]) == {
        1: ("OVERLAP", 1.0, 1.0, "LEXICAL_LINE", "alpha line"), 2: ("OVERLAP", -1.0, 0.0, "DOCUMENT_CONTEXT", "nothing"), 3: ("OVERLAP", 1.0, 1.0, "LEXICAL_LINE", "alpha beta"),
        4: ("OVERLAP", -1.0, 0.0, "DOCUMENT_CONTEXT", "alphabet"), 5: ("OVERLAP", -1.0, 0.0, "DOCUMENT_CONTEXT", ""),
    }
    assert told(none, [1.0, 0.0], ["beta"])[5][0] == "DOCUMENT"
    with pytest.raises(ValueError):
        search.page_of(page, 4)
    rows = spark.createDataFrame([(["a", "b"],), (["a"],)], "have array<string>")
    assert search.coverage_gate(rows, "have", [], ["a", "b"]).count() == 2
    assert search.coverage_gate(rows, "have", [], ["a", "b"], 1.0, minimum_set=True).count() == 1
    assert one(spark, search.evidence_line(F.lit("first\nsecond word"), ["word"]).alias("x")).x == "second word"
    assert one(spark, search.confidence(F.lit(50.0), 2.0, -1.0).alias("x")).x == 0.5


def plain_covers(text, words):
    """Shortest stretches by looking at all: (covers, density)."""
    at = [(i, w) for i, w in enumerate(re.findall(r"\w+", (text or "").lower()), 1) if w in words]
    best = {}
    for i in range(len(at)):
        for j in range(i, len(at)):
            held = {w for _, w in at[i : j + 1]}
            if held == set(words):
                if at[i][1] not in {w for _, w in at[i + 1 : j + 1]} or i == j:
                    best[i] = j
                break
    return len(best), sum(0.1 / (1 + (at[j][0] - at[i][0]) - (j - i)) for i, j in best.items())


def test_cover_density_over_a_positional_index(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "aa", "aa bb cc", "cc aa x y bb aa", "aa aa bb", "a b c"] + [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "Ff"]) for _ in range(40)) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    path = f"file://{tmp_path}/index"
    index.write_index(frame, "id", "text", path)
    found = index.postings(spark, path, ["aa", "bb", "cc"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(token" in plan  # only these tokens' postings are read
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    held = {(r.token, r.id): r.positions for r in found.collect()}
    assert held == {(w, i): [k for k, x in enumerate(words(t), 1) if x == w] for i, t in enumerate(texts) for w in ("aa", "bb", "cc") if w in words(t)}
    for asked in (["aa", "bb", "cc"], ["aa", "bb"], ["aa"]):
        got = {r.id: (r.covers, round(r.density, 9)) for r in index.cover_density(index.postings(spark, path, asked), "id", asked, every=True).collect()}
        want = {i: plain_covers(t, asked) for i, t in enumerate(texts)}
        assert got == {i: (n, round(d, 9)) for i, (n, d) in want.items() if n}
    some = {r.id: r.lexical for r in index.lexical_rank(index.postings(spark, path, ["aa", "ff"]), "id", ["aa", "ff"], 5).collect()}
    counts = sorted(((-sum(w in ("aa", "ff") for w in words(t)), i) for i, t in enumerate(texts)))[:5]
    assert some == {i: pytest.approx(n / counts[0][0]) for n, i in counts}
    assert index.postings(spark, path, []).collect() == []


def test_three_cosines(spark):
    a, b, z = (F.array(*map(F.lit, v)) for v in ([1.0, 0.0], [1.0, 1.0], [0.0, 0.0]))
    row = one(spark, vector.strict_cosine(a, b).alias("x"), vector.strict_cosine(a, z).alias("y"), vector.lenient_cosine(a, F.array(F.lit(1.0))).alias("w"), vector.dot(b, b).alias("d"))
    assert math.isclose(row.x, 1 / math.sqrt(2)) and row.y == 0 and row.w == 0 and row.d == 2
    with pytest.raises(Exception):
        one(spark, vector.strict_cosine(a, F.array(F.lit(1.0))).alias("x"))


def test_text_scalars(spark):
    row = one(
        spark, tx.redact_blank(F.lit("Write to lan.tran@harbour.example or ring (028) 3822 9999, mornings")).alias("a"), tx.redact_blank(F.lit("Nguyen An knows An"), F.array(F.lit("an"), F.lit("NGUYEN AN"))).alias("b"),
        tx.phone_key(F.lit("+84 917 620 483")).alias("c"), tx.phone_key(F.lit("0917 620 483")).alias("d"), tx.phone_key(F.lit("123")).alias("e"), tx.email_key(F.lit(" A@B.co ")).alias("f"),
        tx.fold(F.lit("Học Máy\tĐà")).alias("g"), tx.version_file_name(F.lit("Nguyễn An"), F.lit(2), F.lit(".pdf")).alias("h"), tx.render(F.lit("Hi {{ name }}, {{x}}!"), {"name": F.lit("$1 A")}).alias("i"),
        tx.model_json(F.lit('x ```json\n{"a": 1}\n``` y')).alias("j"), tx.quoted(F.lit("ABC"), F.lit("xabcx")).alias("k"), tx.redact_tags(F.lit("An a@b.co"), F.lit("An")).alias("l"), tx.skill_name(F.lit(" React.JS ")).alias("m"), tx.skill_name(F.lit("C++")).alias("n"),
    )
    assert row.a == "Write to or ring ( , mornings" and row.b == "knows" and row.c == row.d == "0917620483" and row.e is None and row.f == "a@b.co"
    assert row.g == "hoc may da" and row.h == "Nguyễn_An_CV_v2.pdf" and row.i == "Hi $1 A, !" and row.j == '{"a": 1}' and row.k and row.l == "[CANDIDATE_NAME] [EMAIL]" and row.m == "reactjs" and row.n == "c++"


def test_identity_from_text(spark):
    texts = [("NGUYỄN VĂN AN\nSenior Engineer\nan@x.co", None), ("Trần\nThị\nBình\nDeveloper", None), ("Curriculum Vitae\nProfile", "a.pdf"), ("12345", "le_van-c.pdf"), ("", None)]
    rows = spark.createDataFrame(texts, "t string, f string").select(identity.person_name(F.col("t"), F.col("f")).alias("n"), identity.first_email(F.col("t")).alias("e")).collect()
    assert [r.n for r in rows] == ["NGUYỄN VĂN AN", "Trần Thị Bình", "Curriculum Vitae", "le van c", identity.UNKNOWN] and rows[0].e == "an@x.co"


def test_profiles_merge_and_conflict(spark):
    profiles = spark.createDataFrame([("o", 1, "A", "a@x.co", None), ("o", 2, "B", None, "0917620483")], "owner string, profile int, name string, email_key string, phone_key string")
    rows = spark.createDataFrame([("o", "A@X.co", None), ("o", None, "+84 917 620 483"), ("o", "a@x.co", "0917620483"), ("o", "new@x.co", None), ("other", "a@x.co", None)], "owner string, email string, phone string")
    got = [(r.email, r.phone, r.profile, r.conflict) for r in entities.resolve_profiles(rows, profiles).collect()]
    assert sorted(got, key=str) == sorted([("A@X.co", None, 1, False), (None, "+84 917 620 483", 2, False), ("a@x.co", "0917620483", None, True), ("new@x.co", None, None, False), ("a@x.co", None, None, False)], key=str)


def test_version_diff(spark):
    before = spark.createDataFrame([(1, "react", "ReactJS"), (1, "ts", "TypeScript"), (1, "vue", "Vue")], "pair int, key string, raw string")
    after = spark.createDataFrame([(1, "react", "React.js"), (1, "ts", "typescript"), (1, "docker", "Docker")], "pair int, key string, raw string")
    got = {(r.key, r.bucket) for r in entities.diff_skills(before, after, "pair").collect()}
    assert got == {("react", "ALIAS_RENAMED"), ("ts", "unchanged"), ("vue", "removed"), ("docker", "added")}
    row = one(spark, entities.diff_value(F.lit("4"), F.lit("3")).alias("a"), entities.diff_value(F.lit(None), F.lit("x")).alias("b"), entities.diff_value(F.lit(" "), F.lit(None)).alias("c"), entities.experience_conflict(F.lit(4.0), F.lit(3.0)).alias("d"), entities.distinct_in_order(F.array(*map(F.lit, ["B", "a", "b", " ", "A"]))).alias("e"))
    assert (row.a, row.b, row.c, row.d, row.e) == ("modified", "added", None, True, ["B", "a"])
    pairs = entities.similarity(spark.createDataFrame([("abcd", "bcde"), (None, "")], "a string, b string"), "a", "b")
    assert [r.similarity for r in pairs.collect()] == [75, 100]


def test_canary_reasons(spark):
    kind = "struct<samples:int,success_rate:double,p95_latency_ms:int,cost_per_screening_micros:int,outbox_failures:int>"
    rows = spark.createDataFrame([((100, 0.99, 1000, 100, 0), (5, 0.90, 1500, 140, 1)), ((100, 0.99, 1000, 100, 0), (25, 0.98, 1100, 110, 0))], f"base {kind}, new {kind}")
    policy = {"min_canary_samples": 20, "min_success_rate": 0.95, "max_success_rate_drop": 0.02, "max_p95": 30000, "max_latency_regression_percent": 20, "max_cost_regression_percent": 20}
    got = [r.r for r in rows.select(telemetry.canary_reasons("base", "new", policy).alias("r")).collect()]
    assert len(got[0]) >= 4 and got[1] == []


def test_two_percentiles(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 31)], "k string, v double")
    assert rows.agg(telemetry.nearest_rank(0.95, "v").alias("x")).first() == (29.0,)
    assert telemetry.floor_index_rows(rows, "k", "v", 0.95).first().p_value == 28.0
    rng = random.Random(5)
    values = {"a": [float(i) for i in range(1, 31)], "b": [7.0] * 9, "c": [rng.gauss(0, 1) ** 3 for _ in range(501)], "d": [-5.0, 1e9]}
    many = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)], "k string, v double")
    got = {r.k: (r.p50, r.p95, r.p100) for r in telemetry.nearest_ranks(many, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    assert got == {k: tuple(sorted(vs)[math.ceil(len(vs) * p) - 1] for p in (0.5, 0.95, 1.0)) for k, vs in values.items()}


def test_metrics(spark):
    grades = spark.createDataFrame([("q", d, g) for d, g in zip("abcd", (3, 2, 1, 0))] + [("none", "a", 0)], "query string, doc string, grade int")
    ranked = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("dcba")], "query string, doc string, rank int")
    got = {r.query: r for r in scoring.retrieval_metrics(ranked, grades, 2).collect()}
    assert (got["q"].precision, got["q"].recall, got["q"].rr) == (0.0, 0.0, 1 / 3)
    gain = [7, 3, 1, 0]
    assert math.isclose(got["q"].ndcg, (gain[3] / 1 + gain[2] / math.log2(3)) / (gain[0] / 1 + gain[1] / math.log2(3)))
    assert (got["none"].recall, got["none"].ndcg) == (1.0, 1.0)


def test_percentiles_beside_outliers(spark):
    rng = random.Random(2)
    values = [rng.uniform(-50, 50) for _ in range(4000)] + [1e15, -1e300, 0.0, 0.0, 1e-300, float("inf")]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0), ("b", None), ("c", None)], "k string, v double")
    shares = {f"p{n}": n / 100 for n in (1, 25, 49, 50, 51, 75, 99, 100)}
    got = {r.k: r for r in telemetry.nearest_ranks(rows, ["k"], "v", shares).collect()}
    ordered = sorted(values)
    assert [got["a"][name] for name in shares] == [ordered[math.ceil(len(ordered) * p) - 1] for p in shares.values()] and set(got) == {"a", "b"}
    binned = telemetry.nearest_ranks(rows, ["k"], "v", {"p50": 0.5})
    assert binned.collect() and got["b"].p1 == 3.0


def test_metrics_of_several_rankings_in_one_pass(spark):
    rng = random.Random(7)
    grades = [(q, d, rng.randint(0, 3)) for q in range(6) for d in range(rng.randint(1, 40))] + [(9, 1, 0)]
    ranked = [(m, q, d, r) for m in "xy" for q in range(5) for r, d in enumerate(rng.sample(range(60), 25), 1)]
    table, judged = spark.createDataFrame(ranked, "mode string, query int, doc int, rank int"), spark.createDataFrame(grades, "query int, doc int, grade int")
    got = {(r.mode, r.query): r for r in scoring.metrics_at(table, judged, (5, 20), ("mode",)).collect()}
    assert set(got) == {(m, q) for m in "xy" for q in range(5)}
    known = {(q, d): g for q, d, g in grades}
    for (mode, query), r in got.items():
        order = [known.get((query, d), 0) for m, q, d, _ in ranked if (m, q) == (mode, query)]
        best = sorted((g for (q, _), g in known.items() if q == query), reverse=True)
        for k in (5, 20):
            hits, relevant = sum(g >= 2 for g in order[:k]), sum(g >= 2 for g in best)
            gain = lambda gs: sum((2**g - 1) / math.log2(i + 1) for i, g in enumerate(gs[:k], 1))  # noqa: E731, B023
            assert math.isclose(r[f"precision_at_{k}"], hits / k) and math.isclose(r[f"recall_at_{k}"], hits / relevant if relevant else 1.0)
            assert math.isclose(r[f"ndcg_at_{k}"], gain(order) / gain(best) if gain(best) else 1.0, abs_tol=1e-12)
        assert math.isclose(r.rr, next((1 / i for i, g in enumerate(order, 1) if g >= 2), 0.0))
    single = {r.query: r for r in scoring.retrieval_metrics(table.filter("mode = 'x'").drop("mode"), judged, 5).collect()}
    assert set(single) == {*range(6), 9} and (single[9].recall, single[9].ndcg, single[9].rr) == (1.0, 1.0, 0.0)


def test_platt_fit_orders_confidence(spark):
    pairs = spark.createDataFrame([("o", float(s), g) for s, g in zip((10, 20, 30, 40, 60, 70, 80, 90), (0, 0, 0, 1, 2, 2, 3, 3))] + [("flat", float(s), 0) for s in range(9)], "owner string, score double, relevance int")
    fit = scoring.fit_platt(pairs, "owner", "score", "relevance", least=8).collect()
    assert [r.owner for r in fit] == ["o"] and fit[0].slope > 0
    low, high = (1 / (1 + math.exp(-(fit[0].slope * s + fit[0].intercept))) for s in (0.1, 0.9))
    assert low < 0.5 < high
    assert scoring.fit_platt(pairs, "owner", "score", "relevance").count() == 0


def test_screening_and_snippets(spark):
    docs = spark.createDataFrame([(1, "Python developer. 5 years with Docker and Go.")], "id int, text string")
    r = scoring.screen(docs, "text", ["Python", "Kafka"], ["Docker"], 4).first()
    assert (r.required_score, r.preferred_score, r.experience_score, r.experience_years) == (50.0, 100.0, 100.0, 5)
    text = "Intro here. I know Python well. Then more."
    assert one(spark, scoring.snippet(F.lit(text), F.lit(text.index("Python") + 1), F.lit(6)).alias("x")).x == "I know Python well"
    assert one(spark, scoring.route(F.lit(10), 20).alias("a"), scoring.band(F.lit(80), F.lit(0.9), 75, 80).alias("b")) == ("REJECTED", "APPROVE")


def test_slots(spark):
    policies = spark.createDataFrame([("o", "Asia/Ho_Chi_Minh", [0, 1, 2, 3, 4], 9, 17)], "owner string, timezone string, working_days array<int>, start_hour int, end_hour int")
    now = F.lit("2026-09-14").cast("timestamp")
    slots = calendar.candidate_slots(policies, now, 180, 1).collect()
    assert max(s.local_start for s in slots).hour == 14 and all(s.local_start.hour >= 9 for s in slots)
    busy = spark.createDataFrame([("o", datetime(2026, 9, 14, 3, 30), datetime(2026, 9, 14, 4, 0)), ("p", datetime(2026, 9, 14, 5), datetime(2026, 9, 14, 9))], "owner string, busy_start timestamp, busy_end timestamp")
    free = {s.local_start.hour for s in calendar.available_slots(policies, busy, now, 60, 1).collect()}
    assert 10 not in free and {9, 11, 16} <= free
    runs = calendar.merge_runs(spark.createDataFrame([("o", datetime(2026, 1, 1, h)) for h in (1, 2, 3, 5, 5)], "owner string, hour timestamp"), "owner", "hour").orderBy("start").collect()
    assert [(r.start.hour, r.end.hour) for r in runs] == [(1, 4), (5, 6)]
    assert len(one(spark, calendar.weeks_grid(now).alias("d")).d) == 21


def test_sandbox_and_filters(spark):
    allowed = lambda e: one(spark, filters.sandbox_allows(F.lit(e), True, "local@x.co", 3, ["z@x.co"]).alias("a")).a
    assert [allowed(e) for e in ("LOCAL@x.co", "local+3@x.co", "local+4@x.co", "local+0@x.co", "z@x.co", "y@x.co")] == [True, True, False, False, True, False]
    rows = spark.createDataFrame([(1.0, "Hà Nội", "Web", None), (5.0, "hà nội HN", "web", "A")], "years double, location string, source string, category string")
    assert filters.warehouse_filters(rows, 1, 5, "HÀ NỘI", "WEB").count() == 2 and filters.warehouse_filters(rows, category="?", categories=["A"]).count() == 1


def test_chunkers(spark):
    docs = spark.createDataFrame([(1, "skills: a; b; " + "c" * 60 + "; d\nroles: x\nplain")], "id int, text string")
    got = [(r.section, r.ordinal, r.chunk) for r in files.section_chunks(docs, "id", "text", 50).orderBy("section", "ordinal").collect()]
    assert got == [("plain", 0, "plain: plain"), ("roles", 0, "roles: x"), ("skills", 0, "skills: a; b"), ("skills", 1, "skills: " + "c" * 60), ("skills", 2, "skills: d")]
    long = spark.createDataFrame([(1, "aa\n\nbb\n\n" + "x" * 25 + "\n\ncc"), (2, "")], "id int, text string")
    got = [(r.id, r.ordinal, r.chunk) for r in files.paragraph_chunks(long, "id", "text", 10).orderBy("id", "ordinal").collect()]
    assert got == [(1, 0, "aa\nbb"), (1, 1, "x" * 10), (1, 2, "x" * 10), (1, 3, "x" * 5), (1, 4, "cc")]
    assert [r.chunk for r in files.hard_chunks(spark.createDataFrame([(1, "abcde"), (2, "")], "id int, text string"), "id", "text", 2).collect()] == ["ab", "cd", "e"]


def test_paragraph_chunks_hold_the_whole_text(spark):
    text = "\n\n".join(f"{k} " + "x" * 600 for k in range(130)) + "\n\n" + "y" * 20_000
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    got = [r.chunk for r in files.paragraph_chunks(docs, "id", "text").orderBy("ordinal").collect()]
    assert got == [f"{k} " + "x" * 600 for k in range(130)] + ["y" * 900] * 22 + ["y" * 200]
    assert files.paragraph_chunks(docs, "id", "text", cap=100).count() == 100


def test_files_are_guarded(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿a text that is long enough\r\n\r\n  and   more ".encode())
    (tmp_path / "b.txt").write_bytes(b"short")
    (tmp_path / "c.exe").write_bytes(b"x" * 100)
    (tmp_path / "d.pdf").write_bytes(b"no pdf at all")
    rows = {r.path[-5:]: r for r in files.guard(files.extract(files.read_files(spark, str(tmp_path)))).collect()}
    assert rows["a.txt"].reason is None and rows["a.txt"].text == "a text that is long enough\nand more"
    assert [rows[k].reason.split(":")[0] for k in ("b.txt", "c.exe", "d.pdf")] == ["NO_TEXT", "UNSUPPORTED_TYPE", "UNREADABLE"]
    spark.dataSource.register(files.PagedListing)
    (tmp_path / "bytes").mkdir()
    (tmp_path / "bytes" / "bad.txt").write_bytes(b"\xef\xbb\xbfa text whose \xff\xfe bytes aren't UTF-8")
    (tmp_path / "bytes" / "good.txt").write_bytes("﻿a text of twenty or more characters".encode())
    read = files.read_files(spark, str(tmp_path / "bytes"))
    lax = {r.path[-7:]: r for r in files.guard(files.extract(read)).collect()}
    assert lax["bad.txt"].text == "a text whose \ufffd\ufffd bytes aren't UTF-8" and lax["bad.txt"].reason is None and lax["ood.txt"].text.startswith("a text of")
    assert {r.path[-7:]: r.reason for r in files.guard(files.extract(read, strict=True)).collect()} == {"bad.txt": "UNREADABLE: bytes that aren't UTF-8", "ood.txt": None}
    listed = spark.read.format("paged_listing").option("fetch", "tests.paged:fetch").option("size", 2).option("tasks", 2).load()
    assert sorted(r.id for r in listed.collect()) == ["0", "1", "2", "3", "4"]


def test_reports(spark):
    rows = spark.createDataFrame([("j", 2, "B", 80.0, None, ["e"] * 9, None), ("j", 1, "A", 90.5, "Strong", ["x"], ["q"])], "job string, place int, name string, score double, recommendation string, evidence array<string>, questions array<string>")
    text = reports.shortlist_report(rows, "job").first().text
    assert text.index("## 1. A") < text.index("## 2. B") and text.count("- e") == 8
    out = reports.subject_export(spark.createDataFrame([(1, "n")], "id int, name string"), "id", {"notes": spark.createDataFrame([(1, "b"), (1, "a")], "id int, t string")}).first()
    assert out.json == '{"id":1,"name":"n","notes":[{"t":"a"},{"t":"b"}]}'
    assert reports.seed(spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int"), "k").count() == 1


def sweeps(spark):
    start = datetime(2026, 1, 1)
    return [("o", "s", start + timedelta(hours=i), b) for i, b in enumerate([False, True, True, False, False, True, False])] + [("o", "t", start, False)]


def test_alert_states_agree_in_batch_and_stream(spark, tmp_path):
    rows = spark.createDataFrame(sweeps(spark), "owner string, signal string, at timestamp, broken boolean")
    batch = sorted(map(tuple, stateful.alert_log(rows).collect()))
    assert [(r[3], r[4], r[5].hour) for r in batch] == [("OPEN", 1, 1), ("OPEN", 2, 1), ("RESOLVED", 2, 1), ("RESOLVED", 2, 1), ("OPEN", 3, 5), ("RESOLVED", 3, 5)]
    state = None
    for (_, _, at, broken), want in zip(sweeps(spark)[1:7], batch):
        state = stateful.alert_step(state, at, broken)
        assert state == want[3:]
    assert stateful.alert_step(("ACKNOWLEDGED", 1, 0, None), 1, True)[0] == "OPEN"
    assert stateful.notifications(stateful.alert_log(rows)).count() == 2


def test_alert_stream(spark, tmp_path):
    rows = spark.createDataFrame(sweeps(spark), "owner string, signal string, at timestamp, broken boolean")
    for part in (0, 1):
        rows.filter(F.hour("at").between(3 * part, 3 * part + 2 + part)).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = stateful.alert_stream(stream).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(180)
    finally:
        spark.conf.unset(provider)
    assert sorted(map(tuple, spark.table("alerts").collect())) == sorted(map(tuple, stateful.alert_log(rows).collect()))


def test_outbox_and_task_streams_agree_with_their_logs(spark, tmp_path):
    at = lambda n: datetime(2026, 1, 1, 0, n)
    outbox = [("a", at(1), "error"), ("a", at(9), "ok"), ("a", at(10), "error"), ("b", at(2), "blocked"), *(("c", at(n), "error") for n in range(1, 12, 2))]
    tasks = [("t", at(1), False), ("t", at(5), False), ("t", at(9), False), ("u", at(2), False), ("u", at(8), True)]
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, rows, kinds, stream, log in (("outbox", outbox, "event string, at timestamp, outcome string", stateful.outbox_stream, stateful.outbox_log), ("tasks", tasks, "task string, at timestamp, ok boolean", stateful.task_stream, stateful.task_log)):
            frame = spark.createDataFrame(rows, kinds)
            for part in (0, 1):  # two micro-batches, between which the state is kept
                frame.filter(F.minute("at").between(6 * part, 6 * part + 5)).repartition(1).write.mode("append").parquet(str(tmp_path / name))
            source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
            query = stream(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
            query.awaitTermination(180)
            got = spark.table(name)
            assert sorted(map(str, got.collect())) == sorted(map(str, log(frame).select(got.columns).collect()))
            assert {r[0] for r in stateful.dead_letters(got).collect()} == ({"b", "c"} if name == "outbox" else {"t"})
    finally:
        spark.conf.unset(provider)


def test_streams_agree_with_batches(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = spark.createDataFrame([(i, "o", start + timedelta(seconds=30 * i)) for i in range(8)] + [(3, "o", start + timedelta(seconds=90))], "id int, owner string, ts timestamp")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name)

    assert run(stateful.distinct_events(stream(), ["id"]), "append", "deduped").count() == 8
    assert run(stateful.distinct_events(stream(), ["id"], "ts", "1 hour"), "append", "deduped_late").count() == 8
    counts = run(stateful.minute_counts(stream(), "owner", "ts"), "complete", "minutes")
    assert sorted(r.n for r in counts.collect()) == [2, 2, 2, 3]
    usage = run(stateful.monthly_usage(stream(), "owner", "ts", "id"), "complete", "months").first()
    assert (usage.period, usage.used) == ("2026-01", 31)


def test_retry_logs(spark):
    at = datetime(2026, 1, 1)
    rows = spark.createDataFrame([("e", at + timedelta(seconds=i), o) for i, o in enumerate(["error", "error", "ok", "error"])] + [("f", at + timedelta(seconds=i), "error") for i in range(6)], "event string, at timestamp, outcome string")
    got = [(r.event, r.status, r.available_at and (r.available_at - r.at).seconds) for r in stateful.outbox_log(rows).orderBy("event", "at").collect()]
    assert got == [("e", "PENDING", 2), ("e", "PENDING", 4), ("e", "COMPLETED", None)] + [("f", "PENDING", s) for s in (2, 4, 8, 16)] + [("f", "FAILED", None)]
    hooks = stateful.webhook_rows(spark.createDataFrame([('{"provider": "p", "data": {"id": "7"}, "type": "X.Y"}',), ("{}",)], "value string")).collect()
    assert (hooks[0].external_id, hooks[0].type) == ("7", "x.y") and hooks[1].external_id.startswith("sha256:")
