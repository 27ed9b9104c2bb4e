"""One small test for each finding of the third round that was right."""

from datetime import datetime

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylight.functions import vector
from quarrylight.llm import similar
from quarrylight.llm.components import connected_components
from quarrylight.operators import calendar, entities, reading
from quarrylight.operators import postings as index
from quarrylight.plans import registry
from quarrylight.sources import documents as files
from quarrylight.sources import objects


def physical(df):
    """The plan as run, all of its adaptive parts final."""
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rolling_window_counts_seconds_as_its_sql_does(spark, tmp_path):
    times = ["2024-01-09 17:59:59.816118", "2024-01-09 17:59:59.5", "2024-01-09 05:59:58.5", "2024-01-10 06:00:00.4", "1969-12-31 23:59:59.5"]
    rows = [(i, i, datetime.fromisoformat(t)) for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(registry.ORACLE_SQL["rolling_window"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["rolling_window"](spark, str(tmp_path)).collect())) == sorted(want)


def test_slots_and_busy_hours_are_not_broadcast(spark):
    at = lambda h: F.lit("2026-09-14").cast("timestamp") + F.make_interval(hours=h)
    owners = spark.range(50).select(F.col("id").alias("owner"))
    slots = owners.select("owner", at(F.col("owner") % 9).alias("start"), at(F.col("owner") % 9 + 1).alias("end"))
    busy = owners.filter("owner % 2 = 0").select("owner", at(F.lit(0)).alias("busy_start"), at(F.lit(5)).alias("busy_end"))
    free = calendar.free_of_overlap(slots, busy, "owner")
    assert {r.owner for r in free.collect()} == {i for i in range(50) if i % 2 or i % 9 > 4}
    assert "Broadcast" not in physical(free)


def test_readings_of_postings_are_not_broadcast(spark):
    """Only vocabulary and keywords are: tables whose size doesn't follow the texts."""
    docs = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("Backend Developer\nRequirements:\n- Python and Redis\n- "), F.col("id") % 9 + 1, F.lit("+ years of experience\nDocker is a plus.\n")).alias("text"))
    found = reading.read(docs, "k", "text")
    assert "BroadcastHashJoin" not in physical(found["years"])
    for name in ("mentions", "requirements", "attributes"):
        joins = [line for line in physical(found[name]).split("\n") if "BroadcastHashJoin" in line]
        assert joins and all("[alias#" in line and "BuildRight" in line for line in joins)
    got = found["requirements"].filter("k = 7").orderBy("kind", "rank").collect()
    assert [(r.kind, r.name) for r in got] == [("preferred", "Docker"), ("required", "Python"), ("required", "Redis")]


def test_search_documents_are_made_by_all_tasks(spark):
    people = spark.range(40).coalesce(1).select("id", F.lit("An Le").alias("name"))
    found = files.searchable(people, "id", {"roles": F.array(F.lit(" Dev "), F.lit("dev"), F.col("name"))}, F.array(F.col("name")))
    assert found.rdd.getNumPartitions() == 4
    assert {r.text for r in found.collect()} == {"roles: Dev"}


def test_categories_cut_the_texts_once(spark):
    docs = spark.createDataFrame([(1, "Data Engineer\nwe use SQL"), (2, ""), (3, None)], "k long, text string")
    parts = reading.clauses(docs, "k", "text")
    none = parts.select("k", F.lit("").alias("name"), F.lit("tool").alias("kind"), F.lit(None).cast("string").alias("category")).limit(0)
    found = reading.categories(parts, none, "k", keys=reading.keys_of(docs, "k", "text"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, reading.categories(parts, none, "k").collect())) == [(1, "DATA_ENGINEERING", None), (2, "UNCLASSIFIED", None)]
    cuts = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode")
    assert cuts(found) < cuts(reading.categories(parts, none, "k"))


def test_embeddings_leave_a_task_by_slices():
    rows = 2 * vector.SLICE + 5
    batch = pa.RecordBatch.from_pydict({"k": list(range(rows)), "text": [None if i == 3 else f"w{i} spark c++" for i in range(rows)]})
    found = list(vector._embedded(iter([batch])))
    assert [len(set(b.column("k").to_pylist())) for b in found] == [vector.SLICE - 1, vector.SLICE, 5]
    assert all(abs(sum(v * v for k, v in zip(b.column("k").to_pylist(), b.column("value").to_pylist()) if k == b.column("k")[0].as_py()) - 1) < 1e-9 for b in found)


def test_an_index_shuffles_postings_once_and_no_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Aa bb aa c"), (2, None), (3, ""), (4, "bb ß_9 bb"), (4, "cc bb")], "id int, text string")
    plan = index._by_text(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    want = {("aa", 1): [1, 3], ("bb", 1): [2], ("bb", 4): [1, 2, 3], ("ss_9", 4): [2], ("cc", 4): [1]}
    assert {(r.token, r.id): r.positions for r in index.positions(docs, "id", "text").collect()} == want
    for rows, path in ((docs, f"{tmp_path}/repeated"), (docs.filter("text is null or text <> 'cc bb'"), f"{tmp_path}/unique")):
        index.write_index(rows, "id", "text", path)
        held = {(r.token, r.id): r.positions for r in spark.read.parquet(path).collect()}
        assert held == (want if path.endswith("repeated") else {k: [1, 3] if k == ("bb", 4) else v for k, v in want.items() if k[0] != "cc"})
    covers = index.cover_density(index.positions(docs, "id", "text"), "id", ["aa", "bb"], every=True)
    assert physical(covers).split("== Initial Plan ==")[0].count("Exchange hashpartitioning(id") == 1
    assert [(r.id, r.covers, round(r.density, 9)) for r in covers.collect()] == [(1, 2, 0.2)]


def test_version_diff_hashes_numbers_in_even_tasks(spark):
    """Sums of texts would be sorted, and Spark would join what is dealt to few tasks by compressed bytes."""
    df = registry.QUERIES["version_diff"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "REPARTITION_BY_NUM" in plan and "min(l_linenumber" in plan
    assert not [line for line in plan.split("\n") if "SortAggregate" in line]


def test_objects_are_read_without_a_listing_by_the_driver(spark, tmp_path):
    rows = spark.createDataFrame([("t1/1/original.txt", b"a"), ("t1/2/original.txt", b""), ("t2/ä%20b/original.pdf", b"xyz")], "path string, content binary")
    objects.write_objects(rows, f"file://{tmp_path}/o")
    (tmp_path / "o/t2/_staged").mkdir()
    found = objects.read_objects(spark, f"file://{tmp_path}/o")
    assert sorted((r.path, r.length, bytes(r.content)) for r in found.collect()) == [("t1/1/original.txt", 1, b"a"), ("t1/2/original.txt", 0, b""), ("t2/ä%20b/original.pdf", 3, b"xyz")]
    assert "FileScan" not in physical(found)
    (tmp_path / "empty").mkdir()
    assert objects.read_objects(spark, f"file://{tmp_path}/empty").collect() == []


def test_lists_of_a_diff_are_mapped_once(spark):
    rows = spark.createDataFrame([(["A", "b", "B"], ["b", "C"]), (None, ["x"])], "p array<string>, q array<string>").select(entities.diff_lists(F.col("p"), F.col("q")).alias("d"))
    assert [sorted(map(tuple, r.d)) for r in rows.collect()] == [[("added", "C"), ("removed", "A"), ("unchanged", "b")], [("added", "x")]]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("map_from_entries") == 2


def joined_rows(df, kind, text):
    """Rows out of the joins of the plan as run whose line holds `text`."""
    df.collect()

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        below = node.children()
        own = node.metrics().apply("numOutputRows").value() if kind in node.nodeName() and text in node.simpleString(1000) else 0
        return own + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_pair_of_many_buckets_is_joined_once(spark):
    bits = F.array(F.lit(1).cast("long"))
    nodes = spark.range(3).select(F.col("id").alias("node"), F.lit(40).alias("n"), bits.alias("bits"))
    live = nodes.filter("node < 2").crossJoin(spark.range(30).select(F.col("id").alias("key"))).select("key", "node", F.col("node").alias("root"))
    live = live.unionByName(spark.createDataFrame([(99, 1, 1), (99, 2, 2)], live.schema))
    pairs = similar._all_apart(live, nodes, 0.9)
    assert joined_rows(pairs, "Join", "root_a") == 2
    assert sorted(map(tuple, pairs.collect())) == [(0, 1), (1, 2)]


def test_texts_that_are_drawn_can_be_similar(spark):
    """Most of a bucket fits nothing; the others are linked whichever texts come first."""
    own = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.xxhash64("id", i))
    nodes = spark.range(200).select(F.col("id").alias("node"), F.lit(100).alias("n"), F.when(F.col("id") % 4 == 0, F.array_repeat(F.lit(0).cast("long"), 8)).otherwise(own).alias("bits"))
    live = nodes.crossJoin(spark.range(20).select(F.col("id").alias("key"))).select("key", "node", F.col("node").alias("root"))
    pairs = similar._drawn(live, nodes, 0.9, 0)
    found = pairs.collect()
    assert all(r.a % 4 == r.b % 4 == 0 for r in found) and len(found) <= 100
    assert connected_components(pairs, "a", "b").select("root").distinct().count() <= 2


def test_plans_find_what_they_look_up_once(spark):
    """What both sides of a join of pairs need is in a plan once, or written before it."""
    nodes = spark.range(4).select(F.col("id").alias("node"), F.lit(40).alias("n"), F.array(F.lit(1).cast("long")).alias("bits"))
    live = nodes.crossJoin(spark.range(3).select(F.col("id").alias("key"))).select("key", "node", F.col("node").alias("root"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(similar._drawn(live, nodes, 0.9, 0)).count("Window ") == 1
    every = similar._all_apart(live, nodes, 0.9)
    assert plan(every).count("Join ") == 1 and "Window " not in plan(every)
    possible = similar._possible(every, nodes, 0.9)
    assert "Join " not in plan(possible) and possible.count() == 6


def test_the_driver_keeps_short_descriptions_of_plans(spark):
    store, name = spark._jsparkSession.sharedState().statusStore(), "spark.sql.maxPlanStringLength"
    before, said = store.executionsCount(), spark.conf.get(name)
    docs = spark.createDataFrame([(i, "a b c d e f " * (i + 9), "en", "web") for i in range(60)], "doc_id long, text string, lang string, source string")
    corpus_pipeline.quality(spark, docs, "")
    found = store.executionsList(before, 99)
    sizes = [len(found.apply(i).physicalPlanDescription()) for i in range(found.size())]
    assert len(sizes) > 5 and max(sizes) <= corpus_pipeline.PLAN_CHARS + 200 and spark.conf.get(name) == said
