"""Work that must grow no faster than its input."""

import random
import time
import zlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import call_names, components, graph, incremental, resolve
from tessella.plans import registry
from tessella.sources import repository, shared


def test_a_summary_of_a_long_output_takes_its_lines_once(spark):
    n = 20_000
    output = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("a.py#L"), k.cast("string"), F.lit("-9\n  1: x\n2: y\n"))), "\n")
    begin = time.monotonic()
    got = spark.range(1).select(output.alias("out")).select(text.result_summary(F.lit("a"), F.col("out")).alias("s")).first().s
    assert got == "search: a\n" + "\n".join(f"- a.py#L{k}-9  (1: x)" for k in range(1, 9))
    assert time.monotonic() - begin < 30


def test_keys_of_one_file_are_dealt_over_tasks(spark):
    keys = spark.range(5_000).coalesce(1)
    dealt = shared.dealt(keys)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 5_000 and max(sizes) < 2_000


def test_references_parse_each_text_once(spark):
    files = spark.createDataFrame([("a.py", "import os\ndef f(x):\n    return os.getenv(x)\n")], "file string, text string")
    found = repository.references(repository.extracted(files))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert {(r.to_name, r.flow_type, r.confidence) for r in found.collect()} == {("getenv", None, None), ("getenv", "data_flows_to", 0.75), ("getenv", "data_flows_to", None), ("taint:source:env", "taint_source", 0.95)}


def _made(spark, monkeypatch, run):
    """What `run` writes between steps: rows by what it is called."""
    found, own = {}, resolve.written
    monkeypatch.setattr(resolve, "written", lambda df, what: found.setdefault(what, own(df, what)))
    got = run()
    return got.collect(), {k: v.count() for k, v in found.items()}


def test_imports_alike_in_path_and_file_are_looked_up_once(spark, monkeypatch):
    imports = spark.range(3_000).select("id", F.concat(F.lit("pkg/a"), (F.col("id") % 3).cast("string"), F.lit(".py")).alias("from_file")).select(F.col("id").alias("import_id"), F.lit("pkg.b").alias("import_path"), "from_file")
    files = spark.createDataFrame([("src/pkg/b.py",), ("src/pkg/b/__init__.py",), ("lib/pkg/b.py",)], "file string")
    rows, made = _made(spark, monkeypatch, lambda: resolve.import_files(imports, files))
    assert len(rows) == 3_000 and {r.file for r in rows} == {"lib/pkg/b.py"}
    assert made["pairs"] == 3 and made["tries"] == 9


def test_symbols_that_no_edge_names_are_not_looked_at(spark, monkeypatch):
    symbols = spark.range(2_000).select(F.concat(F.lit("s"), "id").alias("fqn"), F.when(F.col("id") < 1_000, "hot").otherwise(F.concat(F.lit("n"), "id")).alias("name"), F.concat(F.lit("pkg/m"), (F.col("id") % 2).cast("string"), F.lit(".py")).alias("file"), (F.col("id") + 1).cast("int").alias("line_start"), (F.col("id") + 2).cast("int").alias("line_end"))
    edges = spark.createDataFrame([("e1", "hot", "pkg/m1.py", None), ("e2", "hot", "x.py", "pkg.m1"), ("e3", "n1999", "x.py", None), ("e4", "gone", "x.py", None), ("e5", "taint:sink:sql", "x.py", None)], "edge_id string, to_name string, from_file string, import_path string")
    rows, made = _made(spark, monkeypatch, lambda: resolve.resolved(edges, symbols, ("from_file",)))
    assert {(r.edge_id, r.from_file, r.level, r.out_name, r.out_file) for r in rows} == {("e1", "pkg/m1.py", 3, "s1", "pkg/m1.py"), ("e2", "x.py", 0, "s1", "pkg/m1.py"), ("e3", "x.py", 4, "s1999", "pkg/m1.py"), ("e5", "x.py", -1, "taint:sink:sql", "")}
    assert made["places"] == 3


def test_a_delta_of_surfaces_is_one_join(spark):
    of = lambda *xs: spark.createDataFrame([("f", x, x) for x in xs], "file string, name string, fqn string")
    delta = incremental.surface_delta(of("a", "a", "b", "b"), of("b", "c", "c"))
    assert delta._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((r.fqn, r.change) for r in delta.collect()) == [("a", "removed"), ("c", "added")]


def test_an_export_writes_what_stays_and_its_summary_nothing(spark, monkeypatch):
    made, own = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, what: made.append(own(df, what)) or made[-1])
    calls = spark.createDataFrame([("a", x, "f", "g", 1, None) for x in "bcdz"] + [("b", "c", "f", "g", 1, 0.5), ("b", "c", "f", "g", 2, 0.7)], "in_name string, out_name string, in_file string, out_file string, line int, confidence double")
    symbols = spark.createDataFrame([(x,) for x in "abcd"], "fqn string")
    assert graph.export_summary(calls, symbols, 3).collect() == [(3, True, 1)] and not made
    nodes, edges, summary = graph.export(calls, symbols, 2)
    assert [m.count() for m in made] == [2] and {tuple(r) for r in edges.collect()} == {("a", "b", None), ("a", "c", None)}
    assert {r.fqn for r in nodes.collect()} == {"a", "b", "c"} and summary.collect() == [(2, True, 1)]
    assert {tuple(r) for r in graph.export(calls, symbols)[1].collect()} >= {("b", "c", 0.7)}


def test_name_edges_are_contracted_before_they_move(spark):
    made = spark.range(6_000).coalesce(1).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("a"), F.concat(F.lit("p"), (F.col("id") % 30).cast("string")).alias("b"))
    stars = components.contracted(made).collect()
    assert len(stars) == 30 and {x for r in stars for x in r} == {*(f"s{k}" for k in range(3)), *(f"p{k}" for k in range(30))}
    assert {(r.fqn, r.component) for r in graph.components(made).collect()} == {(x, f"p{min((f'{k}' for k in range(30) if k % 3 == int(x[1:]) % 3), key=str)}") for x in {y for r in stars for y in r}}


def test_an_expansion_writes_its_hops_only(spark, monkeypatch):
    made, own = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, what: made.append(own(df, what)) or made[-1])
    far = spark.range(3_000).select(F.concat(F.lit("x"), "id").alias("in_name"), F.concat(F.lit("y"), "id").alias("out_name"))
    near = spark.createDataFrame([("b", "a"), ("b", "a"), ("a", "c"), ("d", "b"), ("c", "e"), ("e", "a")], "in_name string, out_name string")
    calls = far.unionByName(near).withColumn("confidence", F.when(F.col("in_name") == "d", 0.5)).withColumns({"in_file": F.lit("f"), "out_file": F.lit("g")})
    base = spark.createDataFrame([("a", 1.0), ("a", 0.2), ("low", 0.1)], "fqn string, score double")
    got = [(r.fqn, round(r.score, 9)) for r in graph.expand(calls, base).collect()]
    assert got == [("b", 0.6), ("e", 0.6), ("c", 0.5), ("d", 0.18)]
    assert sum(m.count() for m in made) == 2 + 3 + 3


_SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not _SF.exists(), reason="the input tables are not here")
@pytest.mark.parametrize("name", ["call_tags", "symbol_context"])
def test_callers_and_callees_come_from_one_reading_of_the_calls(spark, name):
    got = registry.queries()[name](spark, str(_SF))
    leaves = got._jdf.queryExecution().optimizedPlan().collectLeaves()
    # calls have line items twice, as those of orders and of suppliers
    assert sum("l_orderkey" in leaves.apply(k).toString() for k in range(leaves.size())) == 2


def test_call_lists_are_those_of_brute_force(spark):
    pick = random.Random(5)
    files = ["a/x.py", "a/y.py", "b/x.py", "z", "a/b/x.py", None]
    calls = [(f"f{pick.randrange(60)}", "hub" if pick.random() < 0.5 else f"f{pick.randrange(60)}", pick.choice(files), pick.choice(files), 1, pick.choice([None, None, 0.5, 1.0])) for _ in range(600)]
    calls += [(None, "f1", "z", "z", 1, None), ("f1", None, "z", "z", 1, None)]
    symbols = [(f"f{k}", f"n{k % 45}") for k in range(55)] + [("f3", "twin"), ("f3", "twin"), ("hub", "hub"), ("alone", "alone")]
    tables = spark.createDataFrame(calls, "in_name string, out_name string, in_file string, out_file string, line int, confidence double"), spark.createDataFrame(symbols, "fqn string, name string")
    got = graph.call_lists(*tables)
    names, folder = {}, lambda f: f.rpartition("/")[0]
    for fqn, name in symbols:
        names.setdefault(fqn, set()).add(name)

    def side(at, to, x):
        own = [c for c in calls if c[at] == x]
        near = {}
        for c in own:
            k = 2 if None in c[2:4] else 0 if c[2] == c[3] else 1 if folder(c[2]) == folder(c[3]) else 2
            for name in names.get(c[to], ()):
                near[name] = min(k, near.get(name, 2))
        return len(own), any(c[5] is not None and c[5] < 1 for c in own), sorted(near, key=lambda n: (near[n], n))[:30]

    want = {x: (*side(1, 0, x), *side(0, 1, x)) for c in calls for x in c[:2] if x is not None}
    assert max(len(w[2]) for w in want.values()) == 30
    assert {r.fqn: (r.callers, r.callers_inferred, r.caller_names, r.callees, r.callees_inferred, r.callee_names) for r in got.collect()} == want
    of = spark.createDataFrame([("f7",), ("f9",)], "fqn string")
    some = graph.call_lists(*tables, of=of)
    assert {r.fqn: r.caller_names for r in some.collect()} == {x: want[x][2] for x in want if "f7" <= x <= "f9"}
    assert graph.call_lists(*tables, of=of.limit(0)).count() == 0


def test_calls_are_listed_without_a_window_over_them(spark):
    calls = spark.createDataFrame([("a", "b", "f", "f", 1, None)], "in_name string, out_name string, in_file string, out_file string, line int, confidence double")
    plan = graph.call_lists(calls, spark.createDataFrame([("a", "a")], "fqn string, name string"))._jdf.queryExecution().optimizedPlan().toString()
    # the one over symbols
    assert plan.count("Window [") == 1 and "collect_" not in plan


def test_calls_of_a_hub_are_held_in_pieces(monkeypatch):
    seen, own = [], call_names._firsts
    monkeypatch.setattr(call_names, "ROWS", 64)
    monkeypatch.setattr(call_names, "_firsts", lambda rows, *more: seen.append(rows.num_rows) or own(rows, *more))
    pick = random.Random(3)
    # the last two have the same CRC-32
    rows = [("hub", pick.randrange(2), pick.choice([*(f"n{k}" for k in range(50)), None]), pick.randrange(3), pick.random() < 0.01) for _ in range(2_000)]
    rows += [(pick.choice(["plumless", "buckeroo", f"s{pick.randrange(20)}"]), pick.randrange(2), f"n{pick.randrange(9)}", pick.randrange(3), False) for _ in range(600)]
    rows.sort(key=lambda r: zlib.crc32(r[0].encode()))
    told = [(at, chr(near + 4 * inferred + 8 * side + 16 + 32 + 64 * (name is None)) + (name or "")) for at, side, name, near, inferred in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*told[k : k + 10], strict=True)], ["at", "site"]) for k in range(0, len(told), 10)]
    got = [r for b in call_names.told([("callers", "caller_names"), ("callees", "callee_names")], 5)(iter(batches)) for r in b.to_pylist()]

    def side(x, k):
        own_, near = [r for r in rows if r[:2] == (x, k)], {}
        for r in own_:
            near[r[2]] = min(r[3], near.get(r[2], 2))
        return len(own_), any(r[4] for r in own_), sorted(near, key=lambda n: (near[n], n is None, n or ""))[:5]

    assert len(got) == len({r[0] for r in rows}) and max(seen) < 64 + 10
    assert {r["fqn"]: (r["callers"], r["callers_inferred"], r["caller_names"], r["callees"], r["callees_inferred"], r["callee_names"]) for r in got} == {x: (*side(x, 0), *side(x, 1)) for x in {r[0] for r in rows}}


@pytest.mark.skipif(not _SF.exists(), reason="the input tables are not here")
def test_what_an_answer_is_made_of_is_written(spark):
    leaves = registry.queries()["search_answer"](spark, str(_SF))._jdf.queryExecution().optimizedPlan().collectLeaves()
    # the files whose lines are shown; chunks are not made again
    assert sum("text" in leaves.apply(k).toString() and "lang" in leaves.apply(k).toString() for k in range(leaves.size())) == 1
