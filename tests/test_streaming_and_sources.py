"""The change feed as a stream against its batch form, and source trees as tables."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluation, resolve
from tessella.sources import repository
from tessella.streaming import changes

EVENTS = Path("/root/testdata/sf0.001/events.parquet")


@pytest.mark.skipif(not EVENTS.exists(), reason="the input tables are not here")
def test_a_stream_ends_at_the_batch_result(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(EVENTS, tmp_path / "in/events.parquet")
    schema = spark.read.parquet(str(EVENTS)).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    feed = changes.stream(spark, str(tmp_path / "in"), schema, late="3650 days")
    seen = {}

    def apply(batch, n):
        seen[n] = {(r.repo, r.path): (r.kind, r.ts) for r in batch.collect()}

    changes.maintain(feed, apply, str(tmp_path / "state"), once=True).awaitTermination()
    want = {(r.repo, r.path): (r.kind, r.ts) for r in changes.latest(changes.feed(spark.read.parquet(str(EVENTS)))).collect()}
    assert list(seen.values()) == [want]
    windows = changes.windowed(changes.stream(spark, str(tmp_path / "in"), schema), "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete")
    windows.option("checkpointLocation", str(tmp_path / "hours")).trigger(availableNow=True).start().awaitTermination()
    batch = changes.windowed(changes.feed(spark.read.parquet(str(EVENTS))), "1 hour")
    assert sorted(spark.table("hours").collect()) == sorted(batch.collect())


def test_bursts_and_trailing_runs(spark):
    at = lambda s: F.timestamp_seconds(s)
    feed = spark.createDataFrame([(1, "a", "added", 0.0), (1, "a", "modified", 2.0), (1, "b", "deleted", 6.0), (1, "c", "added", 200.0)], "repo long, path string, kind string, s double").withColumn("ts", at(F.col("s"))).drop("s")
    bursts = changes.debounced(feed)
    assert sorted(r.changes for r in bursts.collect()) == [1, 1, 2]
    runs = sorted((r.starts // 1_000_000, r.rearmed) for r in changes.recomputes(bursts).collect())
    assert runs == [(9, False), (39, True), (207, False)]
    closed = spark.createDataFrame([(2, float(c)) for c in (3, 13, 23, 53)], "repo long, s double").select("repo", at(F.col("s")).alias("closed"))
    assert sorted((r.starts // 1_000_000, r.rearmed, r.bursts) for r in changes.recomputes(closed).collect()) == [(7, False, 1), (37, True, 2), (67, True, 1)]
    assert {(r.path, r.kind) for r in changes.latest(feed).collect()} == {("a", "modified"), ("b", "deleted"), ("c", "added")}


def test_a_tree_becomes_files_symbols_and_resolved_calls(spark, tmp_path):
    for name, body in {".gitignore": b"# rules\nout/\n*.log.py\n!keep.log.py\n/top.py\n", "out/x.py": b"x = 1\n", "deep/out/y.py": b"y = 1\n", "a.log.py": b"z = 1\n", "sub/keep.log.py": b"k = 1\n", "top.py": b"t = 1\n", "sub/top.py": b"t = 2\n", "big.py": b"#" * (repository.MOST_BYTES + 1),
                       "sub/.gitignore": b"/d.py\n", "sub/d.py": b"d = 1\n", "a.py": b"class A:\n    def run(self):\n        return helper(1)\n\ndef helper(x):\n    return x\n", "bad.py": b"def (:\n", "bin.py": b"x\0y", "latin.py": "é".encode("latin-1"),
                       ".hidden/h.py": b"def h(): pass\n", "node_modules/m.py": b"def m(): pass\n", "sub/b.py": b"from a import helper\nhelper(2)\n", "sub/c.txt0": b"none"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    files = repository.walk(spark, str(tmp_path), ignored=("none",)).persist()
    assert {(r.file, r.reason) for r in files.collect()} == {("a.py", None), ("bad.py", None), ("bin.py", "binary"), ("latin.py", "not UTF-8"), ("sub/b.py", None), ("sub/keep.log.py", None), ("sub/top.py", None), ("big.py", "too large")}
    rows = repository.extracted(files).persist()
    found = {(r.fqn, r.kind, r.line_start, r.line_end) for r in repository.symbols(rows).collect()}
    assert found == {("a.py::A", "class", 1, 3), ("a.py::A::run", "method", 2, 3), ("a.py::helper", "function", 5, 6)}
    got = {(r.edge_id.split(":")[1], r.out_name) for r in resolve.resolved(repository.references(rows), repository.symbols(rows)).collect()}
    assert got == {("a.py", "a.py::helper"), ("sub/b.py", "a.py::helper")}


def test_rerank_replies(spark):
    assert evaluation.selections('[3, {"index": 1, "ranges": [[2, 1], [4, 9], 5]}, 3, -1, true, "x"]') == [(3, []), (1, [(4, 9)])]
    assert evaluation.selections('{"ranked_indices": [1]}') == [(1, [])] and evaluation.selections("so: <ranked_indices>[2]</ranked_indices>.") == [(2, [])]
    rows = spark.createDataFrame([(i, f"c{i}", 1, 10 + 10 * i) for i in range(4)], "place int, name string, line_start int, line_end int")
    assert [r.name for r in evaluation.reranked(rows, "[2, 0, 9]").orderBy("new_place").collect()] == ["c2", "c0"]
    assert evaluation.reranked(rows, "[]").count() == 0
    assert all(r.fallback for r in evaluation.reranked(rows, "no list").collect())
    cut = {r.name: r.ranges and [tuple(x) for x in r.ranges] for r in evaluation.reranked(rows, '[{"index": 0, "ranges": [[3, 4]]}, {"index": 3, "ranges": [[3, 4], [39, 99], [50, 60]]}, 1]').collect()}
    assert cut == {"c0": None, "c3": [(1, 6), (37, 40)], "c1": None}


def test_chunks_are_added_while_they_fit(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "file string, line_start int, line_end int, at int, content string")
    held = rows(("a", 1, 5, 0, "x" * 10))
    more = rows(("a", 1, 5, 1, "x" * 10), ("b", 1, 5, 2, "y" * 20), ("b", 1, 5, 3, "y" * 20), ("c", 1, 5, 4, "z" * 30), ("d", 1, 5, 5, "w"))
    assert sorted(r.file for r in evaluation.added(held, more, F.length("content"), 45).collect()) == ["a", "b"]
    assert sorted(r.file for r in evaluation.added(held, more, F.length("content"), 61).collect()) == ["a", "b", "c", "d"]
