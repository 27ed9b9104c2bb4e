"""Event-time state against its window twins on shuffled input, and the calibration against a fit over single pairs."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarrylight.operators import scoring
from quarrylight.streaming import timers

START = datetime(2026, 3, 1)


def streamed(spark, tmp_path, rows, stream, late):
    """What a stream gives for rows that arrive in files, shuffled within `late`, and then files of far later events."""
    ordered = rows.orderBy("at").collect()
    rng = random.Random(3)
    shuffled = sorted(ordered, key=lambda r: r.at + timedelta(seconds=rng.uniform(0, late.total_seconds() * 0.9)))
    parts = [shuffled[i : i + 25] for i in range(0, len(shuffled), 25)]
    known = next(r for r in ordered if "event" not in r or r.event in timers.EVENTS)
    later = [[Row(**{**known.asDict(), "at": START + timedelta(days=900 + d), **({"deadline": None} if "deadline" in known else {})})] for d in range(8)]
    for n, part in enumerate([*parts, *later]):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.parquet(str(tmp_path / f"all/{n:03d}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", "true").parquet(str(tmp_path / "all"))
        query = stream(source).writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        spark.conf.unset(provider)
    return spark.table("timed").collect()


def alert_rows(spark):
    rng = random.Random(8)
    rows = [(f"o{rng.randint(0, 2)}", f"s{rng.randint(0, 1)}", START + timedelta(seconds=rng.randint(0, 3000)), rng.choice([*timers.EVENTS, "BREACH", "NOISE"])) for _ in range(160)]
    return spark.createDataFrame(rows, "owner string, signal string, at timestamp, event string")


def test_controlled_alerts_equal_a_fold(spark):
    rows = alert_rows(spark)
    want = []
    held = {}
    for r in sorted((r for r in rows.collect() if r.event in timers.EVENTS), key=lambda r: (r.at, timers.EVENTS.index(r.event))):
        state = held.get((r.owner, r.signal))
        accepted = r.event != "ACKNOWLEDGE" or state is not None and state[0] != "RESOLVED"
        state = held[r.owner, r.signal] = timers.alert_after(state, r.at, r.event)
        if state:
            want.append((r.owner, r.signal, r.at, r.event, *state, accepted))
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, timers.controlled_alerts(rows).collect()), key=key) == sorted(want, key=key)


def test_acknowledging_and_resolving():
    a = timers.alert_after
    opened = a(None, 1, "BREACH")
    assert a(None, 1, "ACKNOWLEDGE") is None and a(None, 1, "RESOLVE") is None and opened == ("OPEN", 1, 1, None, None)
    known = a(opened, 2, "ACKNOWLEDGE")
    assert known == ("ACKNOWLEDGED", 1, 1, 2, None) and a(known, 3, "BREACH") == ("OPEN", 2, 1, 2, None)
    closed = a(known, 4, "RECOVER")
    assert closed == ("RESOLVED", 1, 1, 2, 4) and a(closed, 5, "ACKNOWLEDGE") == closed and a(closed, 5, "RECOVER") == closed
    assert a(closed, 6, "RESOLVE")[4] == 6 and a(closed, 7, "BREACH") == ("OPEN", 2, 7, None, None)


def test_alert_stream_equals_its_batch_form_on_shuffled_input(spark, tmp_path):
    rows = alert_rows(spark)
    got = [r for r in streamed(spark, tmp_path, rows, lambda s: timers.alert_stream(s, "5 minutes"), timedelta(minutes=5)) if r["at"].year == 2026 and r["at"] < START + timedelta(days=1)]
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, timers.controlled_alerts(rows).collect()), key=key)


def deadline_rows(spark):
    rng = random.Random(5)
    rows = [("last", START + timedelta(seconds=1), None)]
    for _ in range(150):
        at = START + timedelta(seconds=rng.randint(0, 3000))
        rows.append((f"e{rng.randint(0, 9)}", at, None if rng.random() < 0.3 else at + timedelta(seconds=rng.choice([-5, 0, 30, 300, 2000]))))
    rows += [("tie", START, START + timedelta(seconds=60)), ("tie", START + timedelta(seconds=60), None), ("late", START, START + timedelta(seconds=60)), ("late", START + timedelta(seconds=61), None)]
    return spark.createDataFrame(rows, "entity string, at timestamp, deadline timestamp")


def test_deadlines_equal_a_fold(spark):
    rows = deadline_rows(spark)
    now = START + timedelta(seconds=2500)
    want, standing = [], {}
    for r in sorted(rows.collect(), key=lambda r: (r.at, r.deadline is not None, r.deadline or r.at)):
        old = standing.pop(r.entity, None)
        if old and r.at > old:
            want.append((r.entity, old))
        if r.deadline:
            standing[r.entity] = max(r.at, r.deadline)
    want = [(e, d) for e, d in [*want, *standing.items()] if d < now]
    got = sorted(map(tuple, timers.passed_deadlines(rows, F.lit(now)).collect()))
    assert got == sorted(want) and ("late", START + timedelta(seconds=60)) in got and not [e for e, _ in got if e == "tie"]


def test_deadline_stream_equals_its_batch_form_on_shuffled_input(spark, tmp_path):
    rows = deadline_rows(spark)
    got = streamed(spark, tmp_path, rows, lambda s: timers.deadline_stream(s, "5 minutes"), timedelta(minutes=5))
    batch = timers.passed_deadlines(rows, F.lit(START + timedelta(days=800)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect())) and len(got) > 20


def plain_platt(scores, relevance):
    x, t = np.clip(np.array(scores) / 100, 0, 1), (np.array(relevance) >= 2).astype(float)
    n, k = len(x), t.sum()
    a, b = 1.0, math.log((k + 1) / (n - k + 1))
    p = lambda: 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
    for _ in range(2000):
        e = p() - t
        a, b = a - 0.1 * ((e * x).sum() / n + 0.01 * a), b - 0.1 * e.sum() / n
    q = np.clip(p(), 1e-12, 1 - 1e-12)
    return a, b, ((p() - t) ** 2).mean(), -(t * np.log(q) + (1 - t) * np.log(1 - q)).mean()


def test_binned_calibration_equals_a_fit_over_single_pairs(spark):
    rng = np.random.default_rng(9)
    own = {"hot": 6000, "few": 40, "odd": 200}
    rows = []
    for owner, n in own.items():
        scores = rng.uniform(-3, 104, n) if owner != "few" else np.round(rng.uniform(0, 100, n), 2)
        rows += [(owner, float(s), int(g)) for s, g in zip(scores, np.clip(rng.normal(scores / 30, 1), 0, 3))]
    rows += [("few", None, 2), ("few", 5.0, None), ("none", 5.0, 0)]
    pairs = spark.createDataFrame(rows, "owner string, score double, relevance int").repartition(7)
    got = {r.owner: (r.slope, r.intercept, r.brier, r.log_loss) for r in scoring.fit_platt(pairs, "owner", "score", "relevance").collect()}
    assert set(got) == set(own)
    for owner in own:
        want = plain_platt(*zip(*((s, g) for o, s, g in rows if o == owner and s is not None and g is not None)))
        assert np.allclose(got[owner], want, atol=2e-8, rtol=0), owner
