"""Queries of listings, sidecars, sessions, exports and evaluation that keep an index in use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import evaluation, filters, graph, incremental, index, intervals
from tessella.plans import graph_queries as g
from tessella.plans.registry import query
from tessella.sources import engine_tables as t
from tessella.sources.tables import table

_L = t.with_tables(t.FILE, t.LINE)


@query(
    "grep_scoped",
    f"""{_L[:-1]}, hit AS (SELECT file, ln, row_number() OVER (PARTITION BY file ORDER BY ln) AS r FROM line WHERE regexp_matches(file, '^/repo/src1[^/]*/.*\\.(en|de)$') AND contains(lower(body), 'ing'))
        SELECT file, ln FROM hit WHERE r <= 20 ORDER BY file, ln LIMIT 200""",
)
def grep_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal, case aside, in files of two endings below folders of a pattern: 20 lines a file and 200 in all."""
    scope = F.col("file").rlike(text.glob("/repo/src1*/**.{en,de}"))
    hits = t.lines(t.files(spark, sf_dir).where(scope)).where(F.contains(F.lower("body"), F.lit("ing")))
    first = hits.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("ln"))).where("r <= 20")
    return first.select("file", "ln").orderBy("file", "ln").limit(200)


@query(
    "read_page",
    f"""{_L[:-1]}, p AS (SELECT file, ln, body, sum(strlen(body) + 1) OVER (PARTITION BY file ORDER BY ln ROWS UNBOUNDED PRECEDING) AS upto, max(ln) OVER (PARTITION BY file) AS n FROM line WHERE ln >= 3)
        SELECT file, count(*) FILTER (upto <= 4096 AND ln < 803) AS lines, CASE WHEN max(n) > max(ln) FILTER (upto <= 4096 AND ln < 803) THEN (max(ln) FILTER (upto <= 4096 AND ln < 803) + 1)::INT END AS next_line FROM p GROUP BY file""",
)
def read_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each file's third line on, at most 800 lines and 4 KiB, and the line to go on from; a reader's page has 64 KiB."""
    return intervals.read_page(t.lines(t.files(spark, sf_dir)), 3, 800, 4096)


@query("byte_lines", f"{_L[:-1]}, b AS (SELECT file, ln, sum(strlen(body) + 1) OVER (PARTITION BY file ORDER BY ln ROWS UNBOUNDED PRECEDING) AS upto, strlen(body) + 1 AS n FROM line) SELECT file, k * 500 AS at, ln FROM b, range(0, 400) t(k) WHERE k * 500 >= upto - n AND k * 500 < upto")
def byte_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of every five hundredth byte, of the first 200,000."""
    return intervals.lines_at(t.lines(t.files(spark, sf_dir)), 500, 400)


@query("sidecar_refresh", f"{t.with_tables(t.SYMBOL)} SELECT fqn, CASE WHEN fqn LIKE 'p:%1' THEN name || '!' ELSE name END AS name FROM symbol WHERE kind = 'function' AND NOT contains(file, '/m3') AND NOT (contains(file, '/m5') AND fqn NOT LIKE 'p:%1') AND (contains(file, '/m5') OR fqn NOT LIKE 'p:%1') UNION ALL SELECT fqn, name FROM symbol WHERE kind = 'function' AND NOT contains(file, '/m3') AND NOT contains(file, '/m5') AND fqn LIKE 'p:%1'")
def sidecar_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols after some files were deleted (m3) and some read again (m5), where only a few symbols are left, under new names."""
    s = t.symbols(spark, sf_dir).where("kind = 'function'").select("fqn", "name", "file")
    gone, read = F.contains("file", F.lit("/m3")), F.contains("file", F.lit("/m5"))
    fresh = s.where(read & F.col("fqn").like("p:%1")).withColumn("name", F.concat("name", F.lit("!")))
    return incremental.refreshed(s, s.where(gone | read).select("file").distinct(), fresh).select("fqn", "name")


@query("foreign_sidecars", "SELECT source AS repo, 'd:' || doc_id AS fqn FROM documents WHERE source <> 'src1' AND doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def foreign_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other repositories' symbols, but for those of an older version and broken rows."""
    key = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.when(key % 5 == 0, 1).otherwise(2).alias("version"), F.when(key % 7 != 0, F.concat(F.lit("d:"), key)).alias("fqn"))
    return incremental.foreign(rows, "src1", 2).select("repo", "fqn")


@query("session_store", "SELECT session, used_at, last FROM (SELECT user_id AS session, epoch_us(max(ts)) AS used_at, arg_max(event_id, (ts, event_id)) AS last FROM events GROUP BY user_id) ORDER BY used_at DESC, session LIMIT 100")
def session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred sessions that were used last, with their last event; a server keeps 8192."""
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(F.max(F.struct("ts", "event_id")).alias("e"))
    return incremental.remembered(events.select("session", F.unix_micros(F.col("e.ts").cast("timestamp")).alias("used_at"), F.col("e.event_id").alias("last")), 100)


@query("remote_ends", f"{g.CS} SELECT fqn, 'repo' || (substr(fqn, 3)::BIGINT % 3) AS repo, 'f' || fqn AS file FROM (SELECT DISTINCT out_name AS fqn FROM calls) WHERE fqn LIKE 'p:%' AND substr(fqn, 3)::BIGINT % 10 = 4 ORDER BY fqn LIMIT 24")
def remote_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth function lives in another repository; so do others, which this one has too."""
    key = F.substring("fqn", 3, 20).try_cast("long")
    functions = t.symbols(spark, sf_dir)
    elsewhere = functions.where("kind = 'function'").where(key % 5 == 4).select("fqn", F.concat(F.lit("repo"), (key % 3).cast("string")).alias("repo"), F.concat(F.lit("f"), "fqn").alias("file"))
    own = functions.where((F.col("kind") != "function") | (key % 10 != 4))
    return graph.remote_ends(t.calls(spark, sf_dir), own, elsewhere)


@query("graph_json", f"""{g.EXPORT} SELECT 'node' AS part, '{{"fqn":"' || fqn || '","kind":"' || kind || '"}}' AS line FROM known WHERE fqn IN (SELECT in_name FROM kept UNION SELECT out_name FROM kept)
    UNION ALL SELECT 'edge', '{{"in_name":"' || in_name || '","out_name":"' || out_name || '"}}' FROM kept""")
def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portable export as lines of JSON."""
    nodes, edges, _ = g.export(spark, sf_dir)
    return graph.as_json(nodes.select("fqn", "kind"), edges.select("in_name", "out_name"))


@query(
    "area_markdown",
    f"""{g.COMPONENTS}, a AS (SELECT component, file, count(*) AS n FROM comp JOIN symbol USING (fqn) GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, file) AS r FROM a),
        s AS (SELECT component, sum(n)::BIGINT AS symbols, count(*) AS files FROM a GROUP BY component)
        SELECT component, '## ' || component || chr(10) || any_value(symbols) || ' symbols in ' || any_value(files) || ' files' || chr(10) || string_agg('- ' || file || ' (' || n || ')', chr(10) ORDER BY r) AS text FROM placed JOIN s USING (component) WHERE r <= 5 GROUP BY component""",
)
def area_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = g.components(spark, sf_dir).join(t.symbols(spark, sf_dir), "fqn").groupBy("component", "file").agg(F.count("*").alias("n"))
    return graph.area_markdown(areas)


@query("hub_summary", f"{g.C[:-1]}, {g.HUBS}, inner_ AS (SELECT DISTINCT in_name, out_name FROM calls WHERE in_name IN (SELECT fqn FROM hub) AND out_name IN (SELECT fqn FROM hub)) SELECT (SELECT count(*) FROM hub) AS nodes, least(count(*), 600) AS edges, count(*) > 600 OR (SELECT count(DISTINCT n) FROM (SELECT in_name AS n FROM calls UNION SELECT out_name FROM calls)) > 250 AS truncated FROM inner_")
def hub_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How large the hub subgraph is, and whether the graph is larger."""
    calls = t.calls(spark, sf_dir)
    hubs = graph.hubs(calls)
    inside = graph.hub_edges(calls, hubs, graph.HUB_EDGES + 1).agg(F.count("*").alias("e"))
    names = calls.select(F.explode(F.array("in_name", "out_name")).alias("n")).distinct().agg(F.count("*").alias("n"))
    # tables of one row
    row = hubs.agg(F.count("*").alias("nodes")).join(F.broadcast(inside)).join(F.broadcast(names))
    return row.select("nodes", F.least("e", F.lit(graph.HUB_EDGES)).alias("edges"), ((F.col("e") > graph.HUB_EDGES) | (F.col("n") > graph.HUBS)).alias("truncated"))


@query("negative_lines", f"{_L} SELECT file, ln FROM line WHERE ln % 9 <> 0 AND contains(lower(body), 'tion')")
def negative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks of one; those with negative numbers, every ninth, are not looked at."""
    from tessella.operators import lexical

    lines = t.lines(t.files(spark, sf_dir)).where(~F.contains(F.lower("file"), F.lit("tion")))
    ln = F.when(F.col("ln") % 9 == 0, -F.col("ln")).otherwise(F.col("ln"))
    found = lexical.pools(lines.select("file", ln.alias("line_start"), ln.alias("line_end"), F.col("body").alias("content")), ["tion"], 1 << 30)
    return found.select("file", F.col("line_start").alias("ln"))


@query("filters_merged", f"{t.with_tables(t.SYMBOL)} SELECT fqn FROM symbol WHERE (contains(kind, 'class') OR contains(kind, 'trait')) AND (contains(file, 'r:1') OR contains(file, 'n:2'))")
def filters_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters within a query and filters given apart, by union."""
    own = filters.parse("kind:class path:r:1 nations")[1]
    apart = filters.parse(filters.augmented("", kinds=("trait",), path="n:2"))[1]
    return t.symbols(spark, sf_dir).where(own.merged(apart).condition(path="file", kind="kind")).select("fqn")


@query("recovery_states", "SELECT doc_id, CASE WHEN doc_id % 2 = 1 AND doc_id % 3 > 0 THEN 'nothing' WHEN doc_id % 5 > 0 THEN 'resolve' WHEN n_chars > 1000 THEN 'rebuild' ELSE 'nothing' END AS todo FROM documents")
def recovery_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index must do at its start: it is committed and resolved, it has raw edges, or it has files."""
    key = F.col("doc_id")
    state = table(spark, sf_dir, "documents").select("doc_id", (key % 2 == 1).alias("committed"), (key % 3 > 0).alias("resolved"), (key % 5).alias("raw_edges"), (F.col("n_chars") > 1000).cast("int").alias("files"))
    return state.select("doc_id", index.recovery(F.col("committed"), F.col("resolved"), F.col("raw_edges"), F.col("files")).alias("todo"))


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: length(w) >= 6))"


@query(
    "benchmark_recall",
    f"""WITH b AS (SELECT item_id, unnest({_WORDS.format('text')}) AS w FROM benchmark), d AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents),
        s AS (SELECT item_id, doc_id, count(*) AS n FROM b JOIN d USING (w) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM s),
        gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(left(trim(b.text), 60)))),
        f AS (SELECT item_id, min(rank) AS first FROM gold LEFT JOIN r USING (item_id, doc_id) GROUP BY item_id)
        SELECT count(*) AS queries, coalesce(round(avg((coalesce(first, 1000000) <= 1)::INT), 6), 0) AS recall_1, coalesce(round(avg((coalesce(first, 1000000) <= 5)::INT), 6), 0) AS recall_5, coalesce(round(avg((coalesce(first, 1000000) <= 10)::INT), 6), 0) AS recall_10 FROM f""",
)
def benchmark_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries, documents ranked by shared long words; right is a document that holds the query's beginning."""
    return evaluation.word_recall(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
