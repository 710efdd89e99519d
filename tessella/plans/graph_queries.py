"""Graph queries over the call sites derived from foreign keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import graph
from tessella.plans.registry import query
from tessella.sources import engine_tables as t
from tessella.sources.tables import table

C = t.with_tables(t.CALLS)
CS = t.with_tables(t.CALLS, t.SYMBOL)
_W = "coalesce(confidence, 1.0)"


def _ends(at: str, to: str, file: str) -> str:
    return f"SELECT {at} AS node, {to} AS other, min({file}) AS file, max({_W}) AS w FROM calls GROUP BY 1, 2"


def _neighbours(at: str, to: str, file: str) -> str:
    return f"""{C} SELECT node, other, file, CASE WHEN w < 1.0 THEN w END AS confidence, w < 1.0 AS inferred
        FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY other, file) AS r FROM ({_ends(at, to, file)})) WHERE r <= 32"""


@query("neighbors_callers", _neighbours("out_name", "in_name", "in_file"))
def neighbors_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(t.calls(spark, sf_dir), "callers")


@query("neighbors_callees", _neighbours("in_name", "out_name", "out_file"))
def neighbors_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(t.calls(spark, sf_dir), "callees")


@query("strongest_edge", f"{C} SELECT in_name, out_name, CASE WHEN max({_W}) < 1.0 THEN max({_W}) END AS confidence FROM calls GROUP BY 1, 2")
def strongest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strongest(t.calls(spark, sf_dir)).select("in_name", "out_name", "confidence")


def levels(seeds: str, depth: int) -> str:
    return f"""WITH RECURSIVE {t.CALLS}, e AS (SELECT DISTINCT in_name, out_name FROM calls), seed AS ({seeds}),
        r AS (SELECT seed, seed AS fqn, 0 AS depth FROM seed UNION SELECT r.seed, e.in_name, r.depth + 1 FROM r JOIN e ON e.out_name = r.fqn WHERE r.depth < {depth}),
        lv AS (SELECT seed, fqn, min(depth)::INT AS depth FROM r GROUP BY 1, 2 HAVING min(depth) > 0)"""


@query("impact_levels", levels("SELECT 'p:1' AS seed", 3) + " SELECT fqn, depth FROM lv")
def impactlevels(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("p:1",)], "seed string")
    return graph.impact(t.calls(spark, sf_dir), seeds).select("fqn", "depth")


@query("impact_budget", levels("SELECT 'p:1' AS seed UNION ALL SELECT 'p:2'", 3) + " SELECT seed, fqn, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, fqn) AS r FROM lv) WHERE r <= 60")
def impact_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixty nearest of what reaches each of two parts; a report shows 512."""
    return graph.impact(t.calls(spark, sf_dir), spark.createDataFrame([("p:1",), ("p:2",)], "seed string"), budget=60)


_SEEDS = [f"p:{i}" for i in range(1, 9)]


@query("impact_multi_seed", levels("SELECT unnest([" + ", ".join(f"'{s}'" for s in _SEEDS) + "]) AS seed", 2) + " SELECT seed, fqn, depth FROM lv")
def impact_multi_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(t.calls(spark, sf_dir), spark.createDataFrame([(s,) for s in _SEEDS], "seed string"), 2)


@query("impact_top_files", levels("SELECT 'p:1' AS seed", 3) + f", {t.SYMBOL} SELECT file, count(*) AS n FROM lv JOIN symbol USING (fqn) GROUP BY file ORDER BY n DESC, file LIMIT 5")
def impact_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.impact(t.calls(spark, sf_dir), spark.createDataFrame([("p:1",)], "seed string"))
    return found.join(t.symbols(spark, sf_dir), "fqn").groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(5)


def _traced(at: str, to: str, start: str, goal: str, depth: int, most: int, cap: int | None) -> str:
    capped = f"SELECT node, other FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY other, file) AS r FROM ({_ends(at, to, 'out_file' if at == 'in_name' else 'in_file')}))" + (f" WHERE r <= {cap}" if cap else "")
    return f"""WITH RECURSIVE {t.CALLS}, e AS ({capped}),
        p AS (SELECT ['{start}'] AS path, '{start}' AS last UNION ALL SELECT list_append(path, e.other), e.other FROM p JOIN e ON e.node = p.last WHERE len(path) <= {depth} AND last <> '{goal}' AND NOT list_contains(path, e.other))
        SELECT array_to_string(path, ' > ') AS path, (len(path) - 1)::INT AS length FROM p WHERE last = '{goal}' ORDER BY p.path LIMIT {most}"""


@query("trace_paths", _traced("in_name", "out_name", "r:0", "p:1", 4, 8, None))
def trace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trace(t.calls(spark, sf_dir), "r:0", "p:1", depth=4, most=8, cap=None)


@query("trace_callers", _traced("out_name", "in_name", "p:1", "r:2", 5, 3, 32))
def trace_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trace(t.calls(spark, sf_dir), "p:1", "r:2", direction="callers")


#: From seeds s (fqn, score), the thirty best-scored names within two hops, as bonus. Needs calls.
EXPANDED = f"""f AS (SELECT node, other, w * 0.6 AS x FROM ({_ends("out_name", "in_name", "in_file")}) UNION ALL SELECT node, other, w * 0.5 FROM ({_ends("in_name", "out_name", "out_file")})),
    h1 AS (SELECT other AS fqn, max(score * x) AS score FROM s JOIN f ON f.node = s.fqn WHERE score * x >= 0.15 AND other NOT IN (SELECT fqn FROM s) GROUP BY 1),
    h2 AS (SELECT other AS fqn, max(score * x) AS score FROM h1 JOIN f ON f.node = h1.fqn WHERE score * x >= 0.15 AND other NOT IN (SELECT fqn FROM s) GROUP BY 1),
    bonus AS (SELECT fqn, max(score) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY fqn ORDER BY round(max(score), 9) DESC, fqn LIMIT 30)"""
_EXPAND = f"{C[:-1]}, s AS (SELECT 'p:' || k AS fqn, 1.0 - k / 40.0 AS score FROM range(0, 20) t(k)), {EXPANDED} SELECT fqn, round(score, 6) AS score FROM bonus"


@query("graph_expand_scored", _EXPAND)
def graph_expand_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.range(20).select(F.concat(F.lit("p:"), "id").alias("fqn"), (1.0 - F.col("id") / 40.0).alias("score"))
    return graph.expand(t.calls(spark, sf_dir), base).select("fqn", F.round("score", 6).alias("score"))


HUBS = f"""hub AS (SELECT fqn, sum(degree)::BIGINT AS degree FROM ((SELECT out_name AS fqn, count(*) AS degree FROM calls GROUP BY 1 ORDER BY degree DESC, fqn LIMIT 1000)
    UNION ALL (SELECT in_name AS fqn, count(*) AS degree FROM calls GROUP BY 1 ORDER BY degree DESC, fqn LIMIT 1000)) GROUP BY fqn ORDER BY degree DESC, fqn LIMIT 250)"""


@query("hub_subgraph_nodes", f"{C[:-1]}, {HUBS} SELECT fqn, degree FROM hub")
def hub_subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(t.calls(spark, sf_dir))


@query("hub_subgraph_edges", f"{C[:-1]}, {HUBS} SELECT DISTINCT in_name, out_name FROM calls WHERE in_name IN (SELECT fqn FROM hub) AND out_name IN (SELECT fqn FROM hub) ORDER BY 1, 2 LIMIT 600")
def hub_subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = t.calls(spark, sf_dir)
    return graph.hub_edges(calls, graph.hubs(calls))


#: Symbols that the export's edges may name but that are not there.
_GONE = "fqn LIKE 'p:%7'"
EXPORT = f"""{CS[:-1]}, known AS (SELECT * FROM symbol WHERE NOT ({_GONE})), best AS (SELECT in_name, out_name, max({_W}) AS w FROM calls GROUP BY 1, 2),
    m AS (SELECT *, in_name IN (SELECT fqn FROM known) AND out_name IN (SELECT fqn FROM known) AS whole FROM best), kept AS (SELECT * FROM m WHERE whole ORDER BY w DESC, in_name, out_name LIMIT 100000)"""


def _known(spark: SparkSession, d: str) -> DataFrame:
    return t.symbols(spark, d).where(f"NOT ({_GONE})")


def export(spark: SparkSession, d: str):
    return graph.export(t.calls(spark, d), _known(spark, d))


@query("graph_export_nodes", f"{EXPORT} SELECT fqn, name, kind, file FROM known WHERE fqn IN (SELECT in_name FROM kept UNION SELECT out_name FROM kept)")
def graph_export_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(spark, sf_dir)[0].select("fqn", "name", "kind", "file")


@query("graph_export_edges", f"{EXPORT} SELECT in_name, out_name, CASE WHEN w < 1.0 THEN w END AS confidence FROM kept")
def graph_export_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(spark, sf_dir)[1]


@query("export_dangling", f"{EXPORT} SELECT least(count(*) FILTER (whole), 100000)::BIGINT AS edges, count(*) FILTER (whole) > 100000 AS truncated, count(*) FILTER (NOT whole) AS dangling FROM m")
def export_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.export_summary(t.calls(spark, sf_dir), _known(spark, sf_dir))


_NODE = lambda c: f"replace({c}, ':', '_') || '[\"' || {c} || '\"]'"
_ARROW = f"CASE WHEN max({_W}) < 1.0 THEN ' -.-> ' ELSE ' --> ' END"


@query(
    "graph_mermaid",
    f"""{C[:-1]}, {HUBS}, he AS (SELECT in_name, out_name, '  ' || {_NODE("in_name")} || {_ARROW} || {_NODE("out_name")} AS line FROM calls
            WHERE in_name IN (SELECT fqn FROM hub) AND out_name IN (SELECT fqn FROM hub) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 600)
        SELECT 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY in_name, out_name) AS text FROM he""",
)
def graph_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hub subgraph as one chart; graph_mermaid_lines has the whole graph."""
    calls = t.calls(spark, sf_dir)
    inside = F.broadcast(graph.hub_edges(calls, graph.hubs(calls)))  # 600 rows at most
    return graph.mermaid(graph.strongest(calls.join(inside, ["in_name", "out_name"], "left_semi")))


@query("graph_mermaid_lines", f"""{C} SELECT '' AS in_name, '' AS out_name, 'flowchart LR' AS line UNION ALL
    SELECT in_name, out_name, '  ' || {_NODE("in_name")} || {_ARROW} || {_NODE("out_name")} FROM calls GROUP BY in_name, out_name""")
def graph_mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole strongest-edge graph as a chart's lines, to be read by in_name and out_name."""
    head = spark.range(1).select(F.lit("").alias("in_name"), F.lit("").alias("out_name"), F.lit("flowchart LR").alias("line"))
    return head.unionByName(graph.mermaid_lines(graph.strongest(t.calls(spark, sf_dir))))


#: By propagation of the least name over all edges, in more rounds than any name of the input tables is away from it.
COMPONENTS = f"""WITH RECURSIVE {t.CALLS}, {t.SYMBOL}, e AS (SELECT DISTINCT in_name AS a, out_name AS b FROM calls), b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT 0 AS k, a AS fqn, a AS l FROM b GROUP BY a UNION ALL SELECT max(r.k) + 1, b.a, least(min(r.l), b.a) FROM r JOIN b ON b.b = r.fqn WHERE r.k < 16 GROUP BY b.a),
    names AS (SELECT fqn FROM symbol UNION SELECT a FROM b), comp AS (SELECT fqn, coalesce(min(l), fqn) AS component FROM names LEFT JOIN r USING (fqn) GROUP BY fqn)"""


def components(spark: SparkSession, d: str) -> DataFrame:
    """Components over all call sites and symbols; a name without an edge to another is a component of its own.

    Every name with such an edge has a component, so only symbols and the names of what calls itself are put beside them."""
    calls, symbols = t.calls(spark, d), t.symbols(spark, d)
    found = graph.components(calls.select(F.col("in_name").alias("a"), F.col("out_name").alias("b")))
    loops = calls.where(F.coalesce(F.col("in_name") == F.col("out_name"), F.lit(True))).select(F.explode(F.array("in_name", "out_name")).alias("fqn"))
    names = symbols.select("fqn").unionByName(loops).distinct()
    return names.join(found, "fqn", "full").select("fqn", F.coalesce("component", "fqn").alias("component"))


@query("connected_components", f"{COMPONENTS} SELECT fqn, component FROM comp")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir)


@query("area_files", f"{COMPONENTS} SELECT component, file, count(*) AS n FROM comp JOIN symbol USING (fqn) GROUP BY ALL")
def area_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir).join(t.symbols(spark, sf_dir), "fqn").groupBy("component", "file").agg(F.count("*").alias("n"))


def _side(at: str, file: str, p: str) -> str:
    return f"SELECT {at} AS fqn, count(*) AS {p}_sites, count(DISTINCT {file}) AS {p}_files, bool_or({_W} < 1.0) AS {p}_inferred FROM calls GROUP BY 1"


@query(
    "caller_callee_stats",
    f"""{C} SELECT fqn, coalesce(caller_sites, 0) AS caller_sites, coalesce(caller_files, 0) AS caller_files, coalesce(caller_inferred, false) AS caller_inferred,
        coalesce(callee_sites, 0) AS callee_sites, coalesce(callee_files, 0) AS callee_files, coalesce(callee_inferred, false) AS callee_inferred
        FROM ({_side("out_name", "in_file", "caller")}) FULL JOIN ({_side("in_name", "out_file", "callee")}) USING (fqn)""",
)
def caller_callee_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.caller_stats(t.calls(spark, sf_dir))


@query(
    "proximity_names",
    rf"""{CS[:-1]}, s AS (SELECT in_name, out_name, min(CASE WHEN in_file = out_file THEN 0 WHEN regexp_replace(in_file, '/?[^/]*$', '') = regexp_replace(out_file, '/?[^/]*$', '') THEN 1 ELSE 2 END) AS near FROM calls GROUP BY 1, 2),
        n AS (SELECT out_name, name, min(near) AS near FROM s JOIN symbol ON fqn = in_name GROUP BY 1, 2),
        f AS (SELECT *, row_number() OVER (PARTITION BY out_name ORDER BY near, name) AS nth FROM n)
        SELECT out_name AS fqn, string_agg(name, ', ' ORDER BY nth) AS names FROM f WHERE nth <= 30 GROUP BY 1""",
)
def proximity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.proximity_names(t.calls(spark, sf_dir), t.symbols(spark, sf_dir))


#: A nation is also known by its region's and its own name; several nations of a region may be meant by the latter alone.
_SCOPED = "scoped AS (SELECT 'world::' || r_name || '::' || n_name AS fqn, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_mktsegment || '::' || n_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"
_ASKED = ("world::{0}::{1}", "{0}::{1}", "{1}")


@query(
    "symbol_references",
    f"""WITH {_SCOPED}, one AS (SELECT r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 7)
        SELECT 'exact' AS asked, fqn FROM scoped, one WHERE fqn = 'world::' || r || '::' || n UNION ALL
        SELECT 'tail', fqn FROM scoped, one WHERE ends_with(fqn, '::' || r || '::' || n) UNION ALL SELECT 'name', fqn FROM (SELECT fqn FROM scoped, one WHERE ends_with(fqn, '::' || n) ORDER BY fqn LIMIT 200)""",
)
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nation by its whole name, by its name's end, and by its last part, which others share: all that may be meant are listed."""
    from tessella.operators import resolve

    nation, region, customer = (table(spark, sf_dir, n) for n in ("nation", "region", "customer"))
    placed = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    named = placed.select(F.concat_ws("::", F.lit("world"), "r_name", "n_name").alias("fqn"), F.col("n_name").alias("name"))
    sold = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("::", "c_mktsegment", "n_name").alias("fqn"), F.col("n_name").alias("name")).distinct()
    symbols, one = named.unionByName(sold), placed.where("n_nationkey = 7").select("r_name", "n_name").first()
    found = [resolve.by_reference(symbols, form.format(*one)).select(F.lit(asked).alias("asked"), "fqn") for asked, form in zip(("exact", "tail", "name"), _ASKED)]
    return found[0].unionByName(found[1]).unionByName(found[2])
