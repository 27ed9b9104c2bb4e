"""Shards, chats, archives, URL lists, decontamination, packing, components and the pipeline against plain versions."""

import hashlib
import io
import math
import re
import struct
import time
import zipfile
from collections import Counter, defaultdict
from datetime import date
from functools import cache

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylight.llm import chat, common, decontam, mcd, packing, pii, queries, sharding, similar, simhash, urls, warc
from quarrylight.llm.components import connected_components

from .test_text_operators import base, came_through, plain_components, plain_fingerprint, plain_mcd, with_clashes

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations", "embeddings", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v).removesuffix(" 00:00:00") for v in row) for row in df[columns].itertuples(index=False))
    assert plain(got) == plain(want)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(50)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_shards_split_hot_keys_and_fit(spark):
    rows = [(7 if i % 3 == 0 else i, "x" * (i % 90)) for i in range(600)] + [(None, "y" * 50)] * 40 + [(1000, "z" * 5000), (1001, None)]
    out = sharding.extendible_shards(spark.createDataFrame(rows, "doc_id long, text string"), 700).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        assert len(r.shard) == r.depth
        by[r.shard].append(r)
    for shard, members in by.items():
        assert sum(m.n_bytes for m in members) == members[0].shard_bytes
        assert members[0].shard_bytes <= 700 or len(members) == 1
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard is inside another
    only_oversized = {s[:-1] for s in names if s}
    for parent in only_oversized:
        assert sum(r.n_bytes for r in out if r.shard.startswith(parent)) > 700
    assert sharding.extendible_shards(spark.createDataFrame([], "doc_id long, text string"), 700).collect() == []
    named = with_clashes(spark.createDataFrame([(f"k{i % 5}", "x" * 100) for i in range(90)], "doc_id string, text string"))
    assert sorted(r.shard_bytes <= 700 for r in sharding.extendible_shards(named, 700).collect()) == [True] * 90


def plain_shards(rows, limit):
    """Shortest fitting prefixes, level by level over all rows: (key, shard) by the operator's own bits."""
    bits = {k: bin(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16))[2:].zfill(60) for k, _ in rows}
    out = {}
    for k, _ in rows:
        for depth in range(61):
            group = [(o, n) for o, n in rows if bits[o].startswith(bits[k][:depth])]
            if len(group) == 1 or sum(n for _, n in group) <= limit:
                out[k] = bits[k][:depth]
                break
    return out


def test_shards_above_and_below_the_first_round_equal_a_plain_split(spark):
    """Sizes so uneven that leaves lie far above the depths that the first round looks at, and below them."""
    rng = np.random.default_rng(41)
    for big, small, limit in (([900_000, 800_000], 40, 2000), ([], 300, 100), ([50], 1, 10_000), ([1 << 20] * 3, 200, 4096)):
        rows = [*enumerate(big), *((1000 + i, int(rng.integers(0, 60))) for i in range(small))]
        frame = spark.createDataFrame([(k, "x" * n) for k, n in rows], "doc_id long, text string")
        got = {r.doc_id: r.shard for r in sharding.extendible_shards(frame, limit).collect()}
        assert got == plain_shards(rows, limit)


def test_directory_covers_every_slot(spark):
    shards = sharding.extendible_shards(spark.createDataFrame([(i, "x" * 100) for i in range(200)], "doc_id long, text string"), 1000)
    slots = sharding.directory(shards).orderBy("first").collect()
    assert slots[0].first == 0 and all(b.first == a.last + 1 for a, b in zip(slots, slots[1:]))


def test_chats_collapse_snapshots(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c"), (5, 0, "user", None), (5, None, None, "late"), (None, 0, "user", "n"), (None, 0, "user", "n"), (None, 3, "user", "other"), (None, 9, "user", "a"), (6, 0, "user", "bb"), (6, 0, "user", "aaa"), (7, 0, "user", "aaa"), (7, 0, "user", "bb")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    rows = chat.collapsed_chats(frame).collect()
    got = {r.conv_id: (r.n_turns, r.text) for r in rows if r.conv_id is not None}
    line = lambda role, text: f"<|{role}|>\n{text}\n<|end|>\n"
    assert got == {3: (3, line("user", "a") + line("assistant", "b") + line("user", "c")), 5: (2, line("user", "") + line("", "late")), 6: (2, "".join(line("user", t) for t in sorted(("aaa", "bb"), key=lambda t: hashlib.md5(t.encode()).hexdigest())))}
    assert sorted(r.text for r in rows if r.conv_id is None) == [line("user", "n"), line("user", "other")]  # each by itself, copies once, beginnings not
    assert chat.collapsed_chats(spark.createDataFrame([], frame.schema)).collect() == []


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (5, "http://a/5", "same"), (3, "http://a/ 3\n", "same"), (2, None, ""), (4, "http://a/4", None), (6, "u", "ü\r\n\r\nWARC/1.1\r\n" * 9), (None, "n", "same")]
    packages = warc.write_packages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/w")
    got = warc.read_records(warc.record_ranges(packages)).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in got) == sorted(
        [("1", "revisit", "5", 4), ("5", "response", "None", 4), ("5", "response", "None", 4), ("3", "revisit", "5", 4), ("2", "revisit", "4", 0), ("4", "response", "None", 0), ("6", "response", "None", 15 * 9 + 9), ("None", "revisit", "5", 4)]
    )
    assert {r.html for r in got if r.page_id == 6} == {rows[6][2]}
    for path in packages.select("path").toPandas()["path"]:  # a plain reader agrees
        with zipfile.ZipFile(path.removeprefix("file://")) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc.ARCHIVE, warc.INDEX}
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    named = with_clashes(spark.createDataFrame([("a/1 é%", "u", "same"), ("b>", "u", "same"), (None, "u", "same"), ("", "u", "other" * 9)], "page_id string, url string, html string"))
    warc.READ_BYTES, kept = 1, warc.READ_BYTES
    try:
        again = {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark, named).collect()}
        read = warc.read_records(warc.record_ranges(warc.write_packages(named, f"file://{tmp_path}/v")), id_type="string").collect()
    finally:
        warc.READ_BYTES = kept
    assert again == {("a/1 é%", "revisit", "b>"), ("b>", "response", None), (None, "revisit", "b>"), ("", "response", None)}
    assert sorted(r.html or "" for r in read) == ["", "", "other" * 9, "same"]


def test_zip_directories_in_both_forms():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a", b"first")
        z.writestr("dir/b", b"second")
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK notes"
    data = plain.getvalue()
    found = warc.members(plain, len(data))
    assert {k: data[a : a + n] for k, (a, n) in found.items()} == {"a": b"first", "dir/b": b"second"}
    # The same archive with every size, offset and count in ZIP64 fields.
    end = data.rfind(warc.END)
    count, length, start = struct.unpack_from("<HII", data, end + 10)
    at, central = start, b""
    while data[at : at + 4] == warc.CENTRAL:
        packed, full = struct.unpack_from("<II", data, at + 20)
        n, m, k = struct.unpack_from("<HHH", data, at + 28)
        local = struct.unpack_from("<I", data, at + 42)[0]
        head = bytearray(data[at : at + 46])
        struct.pack_into("<II", head, 20, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<H", head, 30, 28 + 4)
        struct.pack_into("<I", head, 42, 0xFFFFFFFF)
        central += bytes(head) + data[at + 46 : at + 46 + n] + struct.pack("<HH", 9, 0) + struct.pack("<HHQQQ", 1, 24, full, packed, local)
        at += 46 + n + m + k
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(central), start)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, start + len(central), 1)
    last = warc.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    wide = data[:start] + central + end64 + locator + last
    assert warc.members(io.BytesIO(wide), len(wide)) == found
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"no archive" * 9), 90)


def test_url_lists_as_of_the_fetch(spark):
    captures = [(1, "http://a.b.example.com/x", date(2024, 3, 1)), (2, "https://u:p@B.example.com:80", date(2024, 1, 5)), (3, "http://c.org", date(2024, 2, 1)), (4, None, date(2024, 1, 1)), (5, "no url", None), (6, "http://localhost/", date(2024, 6, 1)), (6, "http://localhost/", date(2024, 6, 1)), (7, "http://b.example.com", date(2023, 1, 1))]
    entries = [("example.com", "allow", date(2024, 1, 1)), ("b.example.com", "block", date(2024, 2, 1)), ("b.example.com", "allow", date(2024, 2, 1)), ("b.example.com", "allow", date(2024, 4, 1)), ("c.org", "block", date(2024, 1, 1)), ("c.org", "allow", date(2024, 2, 1)), ("localhost", "block", date(2020, 1, 1)), (None, "block", date(2020, 1, 1)), ("c.org", None, date(2024, 1, 2))]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched date").withColumn("verdict", F.lit("clash"))
    out = urls.listed_captures(frame, spark.createDataFrame(entries, "domain string, action string, listed date"))
    got = sorted((r.page_id, r.rule, r.verdict) for r in out.collect())
    assert got == [(1, "b.example.com", "block"), (2, "example.com", "allow"), (3, "c.org", "allow"), (4, None, "none"), (5, None, "none"), (6, "localhost", "block"), (6, "localhost", "block"), (7, None, "none")]
    empty = spark.createDataFrame([], "domain string, action string, listed date")
    assert {r.verdict for r in urls.listed_captures(frame, empty).collect()} == {"none"}
    assert urls.listed_captures(frame.limit(0), empty).collect() == []
    clashing = urls.listed_captures(with_clashes(frame), spark.createDataFrame(entries, "domain string, action string, listed date"))
    assert came_through(clashing) and sorted((r.page_id, r.rule, r.verdict) for r in clashing.collect()) == got


def plain_host(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.%]+\]|[^/?#:@\[\]]+)", url or "")
    name = re.sub(r"\.$", "", m[1].lower()) if m else ""
    return name if 0 < len(name) <= 253 else None


def test_lists_as_old_as_the_calendar_cost_a_month(spark):
    entries = spark.createDataFrame([("a.org", "block", date(1, 1, 1)), ("a.org", "allow", date(1999, 5, 5)), ("a.org", "block", date(2024, 3, 9)), ("b.org", "block", date(1, 1, 1)), ("c.org", "block", date(1, 1, 1)), ("c.org", "allow", date(2024, 3, 1))], "domain string, action string, listed date")
    asked = spark.createDataFrame([(h, date(2024, 3, d)) for h in ("a.org", "b.org", "c.org") for d in (1, 8, 9, 30)], "host string, at date")
    found = urls.verdicts(asked, entries)
    assert {(r.host, r.at.day): r.verdict for r in found.collect()} == {("a.org", 1): "allow", ("a.org", 8): "allow", ("a.org", 9): "block", ("a.org", 30): "block", **{("b.org", d): "block" for d in (1, 8, 9, 30)}, **{("c.org", d): "allow" for d in (1, 8, 9, 30)}}
    assert all(n <= 6 for n in rows_made(found, "Generate"))  # an interval meets this month only


def rows_made(frame, kind):
    """Output rows of the nodes of a kind in a plan that has run; explodes of hosts' domains are left out."""
    frame.write.format("noop").mode("overwrite").save()
    pattern = re.compile(r"explode\(sequence")
    nodes, found = [frame._jdf.queryExecution().executedPlan()], []
    frame._jdf.collect()
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if name.endswith("QueryStage") or "QueryStage" in name:
            nodes.append(node.plan())
            continue
        if name == kind and pattern.search(node.simpleString(1000)):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return found


def test_odd_hosts_against_brute_force(spark):
    long = ".".join("a" * 20 for _ in range(12))  # 251 characters
    hosts = ["1.2.3.4", "4.3.4", "example.com.", "[2001:db8::1]:80", "[2001:DB8::1]", "u@[::1]", "a..b", "..", ".", "x.y.z.example.com", "1.2.3.4.", "é.example.com", long, f"b.{long}", ".".join("q" * 9000), "a." * 20 + "example.com"]
    captures = [(i, f"http://{h}/p", date(2024, 1 + i % 12, 1 + i % 28)) for i, h in enumerate(hosts)] + [(99, "http://", date(2024, 1, 1))]
    entries = [(d, "block" if k else "allow", date(2024, 1 + 4 * k, 1)) for k in (0, 1) for d in ("3.4", "1.2.3.4", "Example.com", "example.com.", "1]", "[2001:db8::1]", "[::1]", "y.z.example.com", "a" * 20 + "." + "a" * 20, "b", ".b", "a.a.example.com")]
    start = time.perf_counter()
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in urls.listed_captures(spark.createDataFrame(captures, "page_id long, url string, fetched date"), spark.createDataFrame(entries, "domain string, action string, listed date")).collect()}
    assert time.perf_counter() - start < 60
    for page, url, at in captures:
        name = plain_host(url)
        labels = name.split(".") if name else []
        parents = [] if not name else [name] if re.fullmatch(r"(\d+\.){3}\d+", name) or name[0] == "[" else [".".join(labels[k:]) for k in range(max(1, len(labels) - 1))]
        rule = verdict = None
        for domain in parents:
            active = [(listed, action) for d, action, listed in entries if re.sub(r"\.$", "", d.lower()) == domain and listed <= at]
            if active and rule is None:
                last = max(listed for listed, _ in active)
                rule, verdict = domain, "block" if any(a == "block" for x, a in active if x == last) else "allow"
        assert got[page] == (name, rule, verdict or "none"), url[:60]
    assert got[0][1] == "1.2.3.4" and got[2][:2] == ("example.com", "example.com") and got[14][0] is None


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            here = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(here, row[j])
            last = here
    return row[-1]


@cache
def planted():
    """Documents with whole, paraphrased and partial items, and clean ones; with the pairs that plain rules find."""
    rng = np.random.default_rng(11)
    common, rare = [f"the{k}" for k in range(30)], [f"word{k}" for k in range(3000)]
    make = lambda n: [str(rng.choice(common)) if rng.random() < 0.5 else str(rng.choice(rare)) for _ in range(n)]
    items = {i: make(int(rng.integers(15, 60))) for i in range(40)}
    docs = {}
    for d in range(240):
        text = make(int(rng.integers(40, 400)))
        if d % 2:
            item = list(items[d % 40])
            share = (0.0, 0.15, 0.3, 0.7)[d // 2 % 4]
            for k in np.flatnonzero(rng.random(len(item)) < share):
                item[k] = str(rng.choice(rare))
            at = int(rng.integers(0, len(text)))
            text[at:at] = item
        docs[d] = " ".join(text)
    want = set()
    for d, text in docs.items():
        t = words(text)
        for i, item in items.items():
            n = len(item)
            if len(set(item) & set(t)) >= 0.5 * len(set(item)):
                for first in range(0, max(1, len(t) - decontam.WINDOW + decontam.STRIDE), decontam.STRIDE):
                    if lcs(item, t[max(0, first - n) : first + decontam.WINDOW + n]) >= decontam.SUBSEQUENCE * n:
                        want.add((d, i))
                        break
    return docs, items, want


def test_decontamination_finds_what_brute_force_finds(spark):
    docs, items, want = planted()
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()}
    assert not got - want  # every hit meets the subsequence rule
    assert len(got & want) >= 0.9 * len(want)
    assert {d for d, _ in got} >= {d for d in docs if d % 2 and d // 2 % 4 == 0}  # no verbatim item is missed
    assert not {d for d, _ in got if d % 2 == 0}


def test_decontamination_of_what_every_row_holds(spark):
    rng = np.random.default_rng(12)
    item = [f"item{k}" for k in range(15)]
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 400, 20)), *item, *(f"w{x}" for x in rng.integers(0, 400, 40))]) for _ in range(50)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in decontam.contaminated(frame, bench).collect()) == list(range(50))
    one = spark.createDataFrame([(7, texts[0])], "doc_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(one, bench).collect()] == [7]


def test_decontamination_finds_short_items(spark):
    rng = np.random.default_rng(13)
    vocab = np.array([f"w{k}" for k in range(6000)])
    weight = 1 / np.arange(10, 6010)
    draw = lambda n: [str(x) for x in rng.choice(vocab, n, p=weight / weight.sum())]
    items = [draw(n) for n in (5, 8) for _ in range(150)]
    texts = []
    for item in items:
        text = draw(300)
        text[150:150] = item
        texts.append(" ".join(text))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()}
    for part in (range(150), range(150, 300)):
        assert sum((i, i) in got for i in part) >= 0.9 * len(part)


def test_decontamination_rows_without_words(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (None, "one two three four five six seven eight nine"), (4, "x " * 90_000)], "doc_id long, text string").withColumn("hits", F.lit("clash"))
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven eight nine")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()] == [(None, 3)]
    assert decontam.contaminated(frame, bench.limit(0)).collect() == []
    assert decontam.contaminated(frame.limit(0), bench).collect() == []
    assert sorted(str(r.doc_id) for r in decontam.clean(frame.drop("hits"), bench).collect()) == ["1", "2", "3", "4"]
    clashing = decontam.clean(with_clashes(frame), bench)
    assert came_through(clashing) and clashing.count() == 4 and clashing.columns == with_clashes(frame).columns
    named = spark.createDataFrame([("x", "one two three four five six seven eight nine"), ("x", "one two three four five six seven eight nine")], "doc_id string, text string")
    assert [tuple(r)[:2] for r in decontam.contaminated(named, bench).collect()] == [("x", 3)] * 2


def test_decontamination_in_blocks_of_items(spark):
    docs, items, _ = planted()
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{i}", " ".join(w)) for i, w in items.items()], "item_id string, text string")
    rows = lambda: sorted((r.doc_id, r.item_id, round(r.cosine, 4), r.subsequence, r.answer) for r in decontam.contaminated(frame, bench).collect())
    whole, kept = rows(), decontam.BLOCK
    decontam.BLOCK = 7
    try:
        assert rows() == whole
        assert sorted(r.doc_id for r in decontam.clean(frame, bench).collect()) == sorted(set(docs) - {w[0] for w in whole})
    finally:
        decontam.BLOCK = kept


def test_decontamination_of_a_whole_table_against_an_exhaustive_search(spark):
    """Every window of every document with every item by longest common subsequence."""
    found = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    items = {i: [int(x) for x in decontam.word_hashes([t])[0]] for i, t in duckdb.sql("select item_id, text from '/root/testdata/sf0.01/benchmark.parquet'").fetchall()}
    want = set()
    for doc, text in found:
        t = decontam.word_hashes([text])[0].tolist()
        held = set(t)
        for i, item in items.items():
            if sum(w in held for w in item) >= decontam.SUBSEQUENCE * len(item):
                n = len(item)
                if any(decontam.common_subsequence(item, t[max(0, a - n) : a + decontam.WINDOW + n]) >= decontam.SUBSEQUENCE * n for a in range(0, max(1, len(t) - decontam.WINDOW + decontam.STRIDE), decontam.STRIDE)):
                    want.add((doc, i))
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert len(want) > 20 and len(got & want) >= 0.9 * len(want) and not got - want


def plain_best_fit(items, capacity):
    bins, out = [], []
    for n, s, c in items:
        fit = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= n and not b["s"] & {s} - {0} and not b["c"] & {c} - {0}]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"room": capacity, "s": set(), "c": set()})
        bins[i]["room"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
        out.append(i)
    return out


def test_best_fit_equals_an_exhaustive_search():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 90))
        lengths = sorted(map(int, rng.integers(1, 60, n)), reverse=True)
        items = [(x, int(s and 1 << s), int(c and 1 << c)) for x, s, c in zip(lengths, rng.integers(0, 6, n), rng.integers(0, 9, n))]
        assert packing.best_fit(items, 60) == plain_best_fit(items, 60)


def test_packing_keeps_every_word_and_every_rule(spark):
    rng = np.random.default_rng(6)
    rows = [(i if i % 9 else None, int(rng.integers(0, 250)), f"s{i % 7 if i % 3 else 0}", None if i % 4 else i % 20) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, n long, source string, cluster long").withColumns({"bin": F.lit("clash"), "block": F.lit(1)})
    named = frame.withColumn("name", F.monotonically_increasing_id())
    out = packing.packed(named, 100, "n", doc_id="name", block=200).toPandas()
    known = {r.name: r for r in named.collect()}
    total = out.groupby("doc_id").length.sum().to_dict()
    assert total == {k: r.n for k, r in known.items()}
    for _, part in out.dropna(subset=["bin"]).groupby("bin"):
        assert part.length.sum() <= 100
        if len(part) > 1:
            sources = [known[d].source for d in part.doc_id]
            clusters = [known[d].cluster for d in part.doc_id if known[d].cluster is not None]
            assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)
    assert packing.packed(frame.limit(0), 100, "n").collect() == []


def test_sequences_hold_no_two_near_copies(spark, tmp_path):
    words = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(words[:60] + [f"x{i}"] + words[60:]), "en", f"s{i}", 0) for i in range(12)] + [(None, " ".join(words), "en", None, 0)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    group_of = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(set(group_of.values())) < len(group_of)  # texts differ, but share groups
    for out in (queries.op10_best_fit(spark, str(tmp_path)), corpus_pipeline.best_fit(spark, docs, str(tmp_path))):
        found = out.collect()
        assert len(found) == len(rows)
        held = [(r.bin, group_of[r.doc_id]) for r in found]
        assert len(set(held)) == len(held)


def plain_groups(texts):
    """The least index of each text's component over all pairs of five-word shingle similarity 0.8 or more."""
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if root[i] != root[j] and (x == y or len(x & y) >= 0.8 * len(x | y)):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_near_duplicate_stage_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vocab, shared = [f"w{k}" for k in range(900)], [f"common{k}" for k in range(60)]
    texts = [None, "", " ", "One two", "one TWO", "a b c d e f"]
    for g in range(40):
        t = [str(x) for x in rng.choice(vocab, 150)] + (shared if g % 2 else [])
        for changes in (0, 0, 1, 2, 3, 4):  # up to 20 of some 150 shingles change: similarity 1 down to about 0.75
            other = list(t)
            for at in rng.choice(140, changes, replace=False):
                other[at] = f"new{rng.integers(1 << 40)}"
            texts.append(" ".join(other))
    for _ in range(60):  # one large group whose members differ from each other more than from their source
        other = list(shared * 2 + [f"g{k}" for k in range(100)])
        for at in rng.choice(200, 2, replace=False):
            other[at] = f"new{rng.integers(1 << 40)}"
        texts.append(" ".join(other))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").orderBy(F.rand(2))
    want = sorted(set(plain_groups(texts)))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, DIR).collect()) == want
    four_bits = {r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert len(four_bits) > len(want)  # four bits of four-word fingerprints alone leave linked texts apart
    similar.SAMPLE, kept = 0, similar.SAMPLE  # whatever the order of shingles, and with fewer stars
    rounds = similar.STARS, similar.DRAWS
    similar.STARS, similar.DRAWS = 0, 0
    try:
        assert sorted(r.doc_id for r in similar.deduplicated(frame).collect()) == want
    finally:
        similar.SAMPLE, (similar.STARS, similar.DRAWS) = kept, rounds
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (1, "a b c d e f"), (None, "k l m n o p"), (None, "k l m n o p"), (None, "u v w x y z")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in similar.deduplicated(twice).collect()) == [("1", "a b c d e f"), ("1", "u v w x y z"), ("None", "k l m n o p")]


def test_rows_among_and_without_ids(spark):
    rows = spark.range(2000).select((F.col("id") * 1_000_003 - 7).alias("k"), F.col("id").alias("_word"), F.lit("x").alias("_kept"))
    for words in (common.FILTER_WORDS, 2):  # with a bitmap that tells nothing any more, too
        common.FILTER_WORDS, kept = words, common.FILTER_WORDS
        try:
            for ids in (rows.filter("_word % 3 = 0").select("k"), rows.filter("_word = 5").select("k").unionByName(spark.range(3).select(F.col("id").alias("k"))), rows.limit(0).select("k")):
                inside = {r.k for r in ids.collect()}
                assert sorted(r.k for r in common.among(rows.drop("_word"), ids, "k").collect()) == sorted(k for k in inside if (k + 7) % 1_000_003 == 0 and 0 <= (k + 7) // 1_000_003 < 2000)
                assert sorted(r.k for r in common.without(rows.drop("_word"), ids, "k").collect()) == sorted({r.k for r in rows.collect()} - inside)
        finally:
            common.FILTER_WORDS = kept


def test_bitmaps_and_prefixes():
    rng = np.random.default_rng(31)
    for n in (1, 5, 40, 700, 5000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        keep = a[rng.random(len(a)) < 0.92]
        b = np.unique(np.append(keep, rng.integers(-(1 << 62), 1 << 62, len(a) - len(keep))))
        x, y = similar.bitmap(a), similar.bitmap(b)
        m = min(len(x), len(y))
        fold = lambda v: v[:m] ^ v[m:] if len(v) > m else v
        differ = sum(int(v).bit_count() for v in (fold(x) ^ fold(y)).view(np.uint64).tolist())
        assert differ <= len(np.setxor1d(a, b))  # never more bits than shingles that only one of them has
        some = np.unique(rng.choice(a, n // 2 + 1))
        for order in ((np.zeros(0, np.int64),) * 2, (some, rng.integers(1, 9, len(some)))):
            p, q = (similar.prefix(v, order, 0.8) for v in (a, b))
            assert len(p) == len(a) - math.ceil(0.8 * len(a) - 1e-9) + 1
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                assert len(np.intersect1d(p, q))
    assert len(similar.prefix(np.zeros(0, np.int64), order, 0.8)) == 0


def test_near_duplicate_stage_with_clashing_columns(spark):
    docs = with_clashes(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, None), (3, ""), (3, "x " * 40_000)], "doc_id long, text string"))
    out = similar.deduplicated(docs)
    assert out.columns == docs.columns and came_through(out) and sorted(r.doc_id for r in out.collect()) == [1, 3, 3]
    assert similar.deduplicated(docs.limit(0)).collect() == []
    grouped = simhash.clustered(docs.withColumn("cluster", F.lit("user")), "text")
    assert came_through(grouped) and len({r.cluster for r in grouped.collect()}) == 3 and grouped.count() == 5


def test_packing_equals_a_plain_packing_of_each_block(spark):
    rng = np.random.default_rng(16)
    rows = [(i, int(rng.integers(0, 250)), f"s{i % 7 if i % 3 else 0}", f"c{i % 50}" if i % 4 else None) for i in range(700)]
    rows += [(i, 33, None, "c1") for i in (3, 3, None, None)]  # ids that repeat or are null
    frame = spark.createDataFrame(rows, "doc_id long, n long, source string, cluster string").coalesce(1)
    for block in (10_000, 120):
        out = packing.packed(frame, 100, "n", block=block).toPandas()
        blocks = (out.bin.dropna().astype("int64") // (1 << 32)).nunique()
        assert blocks == max(1, -(-len(rows) // block))
        kept = out[out.length.between(1, 99)]
        for _, part in kept.groupby(kept.bin.astype("int64") // (1 << 32)):
            need = Counter((None if pd.isna(doc) else int(doc), int(n)) for doc, n in zip(part.doc_id, part.length))
            members = []
            for r in rows:
                if r[1] % 100 and need[r[0], r[1] % 100]:
                    need[r[0], r[1] % 100] -= 1
                    members.append(r)
            members.sort(key=lambda r: (-(r[1] % 100), r[0] is None, r[0] or 0))
            number = {v: k for k, v in enumerate(dict.fromkeys([None, *(r[2] for r in members)]))}, {v: k for k, v in enumerate(dict.fromkeys([None, *(r[3] for r in members)]))}
            want = plain_best_fit([(r[1] % 100, number[0][r[2]], number[1][r[3]]) for r in members], 100)
            bins = lambda pairs: sorted(sorted(map(str, v)) for v in pairs.values())
            held, got = defaultdict(list), defaultdict(list)
            for r, bin_ in zip(members, want):
                held[bin_].append(r[0])
            for doc, bin_ in zip(part.doc_id, part.bin):
                got[bin_].append(None if pd.isna(doc) else int(doc))
            assert bins(got) == bins(held)


def test_packing_follows_rows_not_files(spark):
    """Ids that repeat, and rows that are alike, give the same bins however a table is cut."""
    rows = [(7, 10 + i % 30, None, None) for i in range(900)] + [(8, 5, "s", "c")] * 2500 + [(None, 12, None, None)] * 40 + [(i, 350 + i, "s", None) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, n long, source string, cluster string")
    bins = lambda df: sorted((r.bin, r.length, str(r.doc_id)) for r in packing.packed(df, 100, "n", block=100).collect())
    one = bins(frame.coalesce(1))
    assert sum(n for _, n, _ in one) == sum(r[1] for r in rows)
    assert one == bins(frame.repartition(3)) == bins(frame.orderBy(F.rand(4)))
    assert max(Counter(b >> 32 for b, *_ in one).values()) < 200
    assert sorted(r.doc_id for r in packing.packed(with_clashes(frame.limit(30).withColumnRenamed("n", "n_words")), 100, "n_words").collect()) == [7] * 30


def plain_quality(rows):
    """Ids that the quality rules keep, by the plain statistics and estimates of the text operators' tests."""
    passed = []
    for r in rows:
        n, chars, symbols, dup, repeat = base(r.text)
        lines = len([x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        if n >= 50 and 100 * repeat <= 50 * n:
            share = lambda a, b: math.floor(1000 * math.asin(math.sqrt(a / b)) + 0.5)
            passed.append((r.doc_id, r.lang, r.source, (math.floor(1000 * math.log(chars / n) + 0.5), share(symbols, chars), share(dup, lines), share(repeat, n))))
    kept = set()
    for doc, lang, source, x in passed:
        for group in ([p for p in passed if p[1:3] == (lang, source)], [p for p in passed if p[1] == lang], passed):
            if len(group) >= mcd.LEAST_POOL:
                break
        distance = estimated(tuple(p[3] for p in group)).get(x)
        if distance <= mcd.CUTOFF:
            kept.add(doc)
    return kept


@cache
def estimated(features):
    return dict(zip(features, plain_mcd(features)[0].tolist()))


def plain_contaminated(texts, items):
    found = set()
    for doc, text in texts.items():
        t = decontam.word_hashes([text])[0].tolist()
        held = set(t)
        for item in items:
            n = len(item)
            if n and sum(w in held for w in item) >= decontam.SUBSEQUENCE * n and any(decontam.common_subsequence(item, t[max(0, at - n) : at + decontam.WINDOW + n]) >= decontam.SUBSEQUENCE * n for at in range(0, max(1, len(t) - decontam.WINDOW + decontam.STRIDE), decontam.STRIDE)):
                found.add(doc)
    return found


def test_pipeline_stages_equal_plain_versions(spark):
    """Row by row: what each stage keeps and makes of the rows that the one before has left."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, benchmark = docs.columns, spark.read.parquet(f"{DIR}/benchmark.parquet")
    items = [decontam.word_hashes([r.text])[0].tolist() for r in benchmark.collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = docs.orderBy("doc_id").collect()
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
        assert docs.columns == columns, name
        after = {r.doc_id: r for r in docs.collect()}
        texts = {r.doc_id: r.text for r in before}
        if number == 0:
            want = plain_quality(before)
        elif number == 1:
            want = {before[i].doc_id for i in plain_groups([r.text for r in before])}
        elif number == 2:
            want = set(texts) - plain_contaminated(texts, items)
        assert set(after) == want and len(after) == docs.count(), name
        assert number == 3 or len(want) < len(before)  # the first three have something to drop here
        for r in before:
            if r.doc_id in after:
                text = pii.redact(r.text) if number == 3 else r.text
                assert tuple(after[r.doc_id]) == (*(text if c == "text" else len(text) if c == "n_chars" and number == 3 else r[c] for c in columns),), name
    out = corpus_pipeline.best_fit(spark, docs, DIR).toPandas()
    rows = docs.collect()
    cluster = dict(zip((r.doc_id for r in rows), plain_components([r.doc_id for r in rows], [plain_fingerprint(r.text) for r in rows])))
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows}
    assert out.groupby("doc_id").length.sum().to_dict() == sizes
    rest = sorted((r for r in rows if sizes[r.doc_id] % corpus_pipeline.SEQUENCE), key=lambda r: (-(sizes[r.doc_id] % corpus_pipeline.SEQUENCE), r.doc_id))
    number_of = {v: i + 1 for i, v in enumerate({r.source for r in rows})}
    bins = plain_best_fit([(sizes[r.doc_id] % corpus_pipeline.SEQUENCE, number_of[r.source], cluster[r.doc_id] + 1) for r in rest], corpus_pipeline.SEQUENCE)
    held, got = defaultdict(set), defaultdict(set)
    for r, bin_ in zip(rest, bins):
        held[bin_].add(r.doc_id)
    for doc, bin_ in out[out.length.between(1, corpus_pipeline.SEQUENCE - 1)][["doc_id", "bin"]].itertuples(index=False):
        got[bin_].add(doc)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, held.values()))
    again = corpus_pipeline.run(spark, DIR).toPandas()
    order = ["doc_id", "piece"]
    assert again.sort_values(order, ignore_index=True).equals(out.sort_values(order, ignore_index=True)[again.columns])


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names, through every stage."""
    prose = " ".join(f"word{k % 97} and{k % 89} so{k % 83}" for k in range(120))
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, prose, None, "a", 1), (None, prose, None, "a", 1), (5, prose + " x@y.co", "de", None, 2), (6, "long " + " ".join(f"w{k}" for k in range(60_000)), "en", "b", 3)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and came_through(out), name
    kept = [stage(spark, docs, DIR).count() for _, stage in corpus_pipeline.STAGES]
    assert kept[0] <= 4 and kept[1] == 3 and kept[2] == 6 and kept[3] == 6 and kept[4] >= 6  # null and empty are copies, as are the three of prose


def test_pipeline_of_no_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.collect() == []
