"""Evaluation sets with flaws, objects that appear together or not at all, and search documents with their digest."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quarrylight.sources import documents as files
from quarrylight.sources import evalsets, objects


def test_evaluation_sets_are_checked(spark, tmp_path):
    document = lambda i, text="some text", **more: {"id": i, "document": text, "skills": ["a"], "experience_years": 2.5, **more}
    query = lambda i, grades, text="find": {"id": i, "text": text, "language": "en", "required_skills": ["a"], "relevance": grades}
    sets = {
        "good.json": {"dataset_version": "g", "corpus": [document("d1"), document("d2", unknown=1)], "queries": [query("q1", {"d1": 3, "d2": 0}), query("q2", {})]},
        "flawed.json": {"dataset_version": "f", "corpus": [document("d1"), document("d1", "again"), document(None), document("d3", " ")], "queries": [query("q1", {"d1": 4, "d3": 1, "d9": 2, "dn": None}), query("", {"d1": 1}), query("q1", {"d1": 1})]},
        "empty.json": {"dataset_version": "e", "corpus": [], "queries": []}, "unnamed.json": {"corpus": [document("d1")], "queries": []},
    }
    for name, content in sets.items():
        (tmp_path / name).write_text(json.dumps(content, indent=2))
    (tmp_path / "broken.json").write_text('{"dataset_version": "b", ')
    out = evalsets.evaluation_sets(evalsets.read_sets(spark, str(tmp_path)))
    rows = lambda name, *c: sorted(tuple(str(v) for v in r) for r in out[name].select(*c).collect())
    assert rows("judgments", "dataset", "query", "document", "grade") == [("g", "q1", "d1", "3"), ("g", "q1", "d2", "0")]
    assert rows("documents", "dataset", "id", "document", "experience_years") == [("f", "d1", "some text", "2.5"), ("g", "d1", "some text", "2.5"), ("g", "d2", "some text", "2.5")]
    assert rows("queries", "dataset", "id", "text") == [("f", "q1", "find"), ("g", "q1", "find"), ("g", "q2", "find")]
    assert rows("rejected", "dataset", "part", "item", "reason") == sorted([
        ("None", "set", "None", "not a set"), ("None", "set", "None", "no version"), ("f", "document", "None", "no id"), ("f", "document", "d1", "id used before"), ("f", "document", "d3", "no text"),
        ("f", "query", "", "no id"), ("f", "query", "q1", "id used before"), ("f", "judgment", "q1/d1", "grade"), ("f", "judgment", "q1/d3", "unknown document"), ("f", "judgment", "q1/d9", "unknown document"), ("f", "judgment", "q1/dn", "grade"),
    ])


def stored(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


def test_objects_appear_together(spark, tmp_path):
    rows = spark.createDataFrame([(f"o{i % 3}", f"item {i}/{i}", "CV.PDF" if i % 5 else "x.exe", f"content {i}".encode()) for i in range(40)] + [(None, "1", "a.pdf", b"x"), ("o/../..", "é", "dir.pdf/a.txt", b""), ("o", "n", None, b"x")], "owner string, item string, name string, content binary")
    placed = rows.withColumn("path", objects.object_path(F.col("owner"), F.col("item"), F.col("name"))).repartition(4)
    root = tmp_path / "objects"
    objects.write_objects(placed, f"file://{root}")
    want = {f"o{i % 3}/{objects.quoted_name(f'item {i}/{i}')}/original.pdf": f"content {i}".encode() for i in range(40) if i % 5}
    assert stored(root) == want | {f"{objects.quoted_name('o/../..')}/%C3%A9/original.txt": b""}
    objects.write_objects(placed.limit(1).withColumns({"path": F.lit("o0/item%200%2F0/original.pdf"), "content": F.lit(b"new")}), f"file://{root}")
    assert stored(root)["o0/item%200%2F0/original.pdf"] == b"new"  # replaced, as nothing else is


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = tmp_path / "objects"
    good = spark.createDataFrame([(f"a/{i}/original.txt", b"x") for i in range(20)], "path string, content binary").repartition(4)
    for bad in ("a/../b.txt", "a//b.txt", "", "a/0/original.txt"):
        both = good.unionByName(spark.createDataFrame([("a/0/original.txt", b"y"), (bad, b"x")], "path string, content binary").coalesce(1))
        with pytest.raises(Exception, match="not an object's path"):
            objects.write_objects(both, f"file://{root}")
        assert stored(root) == {}
    writer = objects.ObjectWriter(f"file://{root}")
    done = writer.write(iter([{"path": "a/1/original.txt", "content": b"x"}]))
    assert done.count == 1 and all(p.startswith("_staged/") for p in stored(root))  # not in its place before all have ended
    writer.abort([done, None])
    assert stored(root) == {}
    again = objects.ObjectWriter(f"file://{root}")
    again.commit([again.write(iter([{"path": "a/1/original.txt", "content": None}])), again.write(iter([]))])
    assert stored(root) == {"a/1/original.txt": b""}


def test_search_documents_and_digests(spark):
    rows = spark.createDataFrame([(1, "Ann Lee", ["Rust", "rust ", None, " "], 'Says "hi"\tto Ann Lee, +84 912 345 678'), (2, None, [], None)], "id int, name string, skills array<string>, about string")
    sections = {"canonical skills": F.col("skills"), "professional summary": F.array("about"), "roles": F.array(F.lit("ann LEE's mail is a@b.co"))}
    got = {r.id: r for r in files.searchable(rows, "id", sections, F.array(F.coalesce("name", F.lit("")))).collect()}
    assert got[1].text == "roles: 's mail is\ncanonical skills: Rust\nprofessional summary: Says \"hi\" to ,"
    assert got[2].text == "roles: ann LEE's mail is"
    for r in got.values():
        assert r.content_hash == hashlib.sha256(json.dumps({"template": files.TEMPLATE, "text": r.text}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    with pytest.raises(ValueError):
        files.searchable(rows, "id", {"hobbies": F.col("skills")}, F.array(F.lit("")))
