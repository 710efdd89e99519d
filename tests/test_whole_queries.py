"""Queries over the whole graph, against brute force over the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

from tessella.plans import registry
from tessella.sources import engine_tables as t

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the input tables are not here")


def test_components_of_the_whole_graph(spark):
    calls = t.calls(spark, str(SF)).select("in_name", "out_name").collect()
    files = {r.fqn: r.file for r in t.symbols(spark, str(SF)).collect()}
    up = {x: x for x in [*files, *(x for r in calls for x in r)]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in calls:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in up}
    got = registry.queries()["connected_components"](spark, str(SF)).collect()
    assert len(got) == len(want) and {r.fqn: r.component for r in got} == want
    assert {"r:0", "n:0", "c:1", "s:1"} <= set(want)
    areas = {(r.component, r.file): r.n for r in registry.queries()["area_files"](spark, str(SF)).collect()}
    assert areas == Counter((want[x], f) for x, f in files.items())


def test_chart_of_the_whole_graph(spark):
    best = {}
    for r in t.calls(spark, str(SF)).collect():
        w = 1.0 if r.confidence is None else r.confidence
        best[r.in_name, r.out_name] = max(w, best.get((r.in_name, r.out_name), 0.0))
    got = registry.queries()["graph_mermaid_lines"](spark, str(SF)).collect()
    assert len(got) == len(best) + 1 and min(got).line == "flowchart LR"
    dotted = {(r.in_name, r.out_name) for r in got if " -.-> " in r.line}
    assert dotted == {k for k, w in best.items() if w < 1.0} and dotted
