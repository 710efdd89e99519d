"""Queries that measure chunks and rankings, shape answers, and tell the state of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import paths, text
from tessella.operators import evaluation, intervals, vector
from tessella.plans.registry import query
from tessella.sources import engine_tables as t
from tessella.sources.tables import table

_S = t.with_tables(t.SYMBOL)[:-1] + ", sym AS (SELECT fqn, file, line_start, line_end FROM symbol WHERE kind = 'function')"
_CH = "ch AS (SELECT DISTINCT file, greatest(line_start - 3, 1)::INT AS line_start, (line_start + 12)::INT AS line_end FROM sym)"
_WIDE = "wide AS (SELECT DISTINCT file, (line_start // 40 * 40 + 1)::INT AS line_start, (line_start // 40 * 40 + 60)::INT AS line_end FROM sym)"


def _functions(spark: SparkSession, d: str) -> DataFrame:
    return t.symbols(spark, d).where("kind = 'function'").select("fqn", "file", "line_start", "line_end")


def _narrow(s: DataFrame) -> DataFrame:
    return s.select("file", F.greatest(F.col("line_start") - 3, F.lit(1)).alias("line_start"), (F.col("line_start") + 12).alias("line_end")).distinct()


def _wide(s: DataFrame) -> DataFrame:
    at = (F.floor(F.col("line_start") / 40) * 40).cast("int")
    return s.select("file", (at + 1).alias("line_start"), (at + 60).alias("line_end")).distinct()


def _quality(n: str, src: str) -> str:
    return f"""{n}_lap AS (SELECT *, lag(line_end) OVER (PARTITION BY file ORDER BY line_start, line_end) >= line_start AS laps FROM {src}),
        {n}_size AS (SELECT count(*) AS chunks, sum(line_end - line_start + 1)::BIGINT AS lines, max(line_end - line_start + 1) AS largest, (count(*) FILTER (laps))::BIGINT AS laps FROM {n}_lap),
        {n}_cov AS (SELECT count(*) AS covered FROM (SELECT DISTINCT file, unnest(generate_series(line_start, line_end)) FROM {src})),
        {n}_pair AS (SELECT c.file, c.line_start, c.line_end, s.fqn, s.line_start >= c.line_start AND s.line_end <= c.line_end AS whole FROM {src} c JOIN sym s ON s.file = c.file AND s.line_start <= c.line_end AND s.line_end >= c.line_start),
        {n}_per AS (SELECT count(*) AS n FROM {n}_pair GROUP BY file, line_start, line_end),
        {n}_held AS (SELECT count(*) FILTER (n = 1) AS with_1, count(*) FILTER (n = 2) AS with_2, count(*) FILTER (n > 2) AS with_more FROM {n}_per),
        {n}_cut AS (SELECT count(*) FILTER (NOT w) AS cut, count(*) AS met FROM (SELECT bool_or(whole) AS w FROM {n}_pair GROUP BY fqn)),
        {n} AS (SELECT chunks, lines, largest, laps, lines / covered AS duplication, chunks - with_1 - with_2 - with_more AS with_0, with_1, with_2, with_more, cut / met AS cut_rate FROM {n}_size, {n}_cov, {n}_held, {n}_cut)"""


@query("chunk_quality", f"{_S}, {_CH}, {_quality('q', 'ch')} SELECT * FROM q")
def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _functions(spark, sf_dir)
    return evaluation.quality(_narrow(s), s)


_NUMBERS = ("chunks", "lines", "largest", "laps", "duplication", "with_0", "with_1", "with_2", "with_more", "cut_rate")


@query("ab_delta", f"{_S}, {_CH}, {_WIDE}, {_quality('q', 'ch')}, {_quality('r', 'wide')} SELECT " + ", ".join(f"r.{c} - q.{c} AS {c}" for c in _NUMBERS) + " FROM q, r")
def ab_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _functions(spark, sf_dir)
    return evaluation.deltas(evaluation.quality(_narrow(s), s), evaluation.quality(_wide(s), s))


@query(
    "retrieval_metrics",
    f"""{_S}, {_CH}, p AS (SELECT fqn, s.line_start AS a, s.line_end AS b, c.line_start AS x, c.line_end AS y FROM sym s JOIN ch c ON s.file = c.file AND s.line_start <= c.line_end AND s.line_end >= c.line_start),
        k AS (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY x DESC, y) AS r, (least(b, y) - greatest(a, x) + 1) / (greatest(b, y) - least(a, x) + 1) AS iou FROM p)
        SELECT count(*) AS queries, avg((first IS NOT NULL AND first <= 1)::INT) AS recall_1, avg((first IS NOT NULL AND first <= 5)::INT) AS recall_5, avg((first IS NOT NULL AND first <= 10)::INT) AS recall_10, avg(coalesce(iou, 0)) AS mean_iou
        FROM (SELECT s.fqn, min(k.r) AS first, max(k.iou) FILTER (k.r <= 10) AS iou FROM sym s LEFT JOIN k USING (fqn) GROUP BY s.fqn)""",
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function asks for itself; its chunks are ranked from the last that starts."""
    s = _functions(spark, sf_dir)
    found = intervals.overlapping(s, _narrow(s)).select(F.col("fqn").alias("query"), "file", F.col("r_line_start").alias("line_start"), F.col("r_line_end").alias("line_end"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("line_start"), "line_end")))
    return evaluation.retrieval(ranked, s.withColumnRenamed("fqn", "query"))


#: Of a file's lines the first of each sixty to the twentieth lie in a symbol.
_HELD = "held AS (SELECT file, n, unnest(generate_series(1, n, 60))::INT AS a FROM (SELECT file, len(string_split(text, chr(10))) AS n FROM file)), sy AS (SELECT file, n, a, least(a + 19, n)::INT AS b FROM held)"


@query(
    "legacy_windows",
    f"""{t.with_tables(t.FILE)[:-1]}, {_HELD}, gap AS (SELECT file, b + 1 AS a, least(coalesce(lead(a) OVER (PARTITION BY file ORDER BY a), n + 1) - 1, n) AS b FROM sy)
        SELECT file, a AS line_start, b AS line_end FROM sy UNION ALL SELECT file, s::INT, least(s + 49, b)::INT FROM (SELECT file, b, unnest(generate_series(a, greatest(a, b - 25), 25)) AS s FROM gap WHERE a <= b)""",
)
def legacy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols as they are, and windows of fifty lines over what they leave uncovered."""
    files = t.files(spark, sf_dir).select("file", F.size(F.split("text", "\n")).alias("n_lines"))
    held = files.select("file", F.explode(F.sequence(F.lit(1), F.col("n_lines"), F.lit(60))).alias("line_start")).withColumn("line_end", F.col("line_start") + 19)
    return evaluation.legacy_windows(files, held)


@query("latency_percentile", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value")


@query(
    "budget_assembly",
    f"""{t.with_tables(t.FILE)} SELECT repo, doc_id, CASE WHEN sum(length(text)) OVER (PARTITION BY repo ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 30000 THEN md5(text) ELSE md5(string_split(text, chr(10))[1]) END AS shown,
        sum(length(text)) OVER (PARTITION BY repo ORDER BY doc_id ROWS UNBOUNDED PRECEDING) <= 30000 AS whole FROM file""",
)
def budget_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repo's blocks: whole while they fit, then the first line only."""
    placed = evaluation.within_budget(t.files(spark, sf_dir), "repo", "doc_id", F.length("text"), 30_000)
    return placed.select("repo", "doc_id", F.md5(F.when(F.col("whole"), F.col("text")).otherwise(F.substring_index("text", "\n", 1))).alias("shown"), "whole")


@query("stable_partition", f"{t.with_tables(t.SYMBOL)} SELECT fqn, name, (row_number() OVER (PARTITION BY name ORDER BY contains(file, '_pb2.py'), fqn))::INT AS place FROM symbol WHERE kind = 'function'")
def stable_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of symbols of a name those in hand-written files come first, else in their order."""
    order = Window.partitionBy("name").orderBy(paths.is_generated(F.col("file")), "fqn")
    return t.symbols(spark, sf_dir).where("kind = 'function'").select("fqn", "name", F.row_number().over(order).alias("place"))


_REPLY = '<ranked_indices>[4, {"index": 2, "ranges": [[1000000, 1000001], [3, 4]]}, 99, 4, {"index": 0, "ranges": [[1, 3], [9, 2]]}, "x", {"index": 7, "ranges": [[1, 900]]}]</ranked_indices>'
#: As the reply says: place, order, and ranges that can be used.
_NAMED = "(4, 0, []), (2, 1, [[1000000, 1000001], [3, 4]]), (0, 2, [[1, 3]]), (7, 3, [[1, 900]])"


@query(
    "rerank_apply",
    f"""WITH c AS (SELECT vec_id, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) DESC, vec_id) - 1 AS place, 1 + vec_id % 3 AS a, 1 + vec_id % 3 + vec_id % 40 AS b FROM embeddings QUALIFY place < 10),
        m AS (SELECT *, list_filter(list_transform(r, lambda x: [greatest(x[1] - 2, a), least(x[2] + 2, b)]), lambda x: x[1] <= x[2]) AS cut FROM c JOIN (VALUES {_NAMED}) v(p, o, r) ON place = p)
        SELECT vec_id, (row_number() OVER (ORDER BY o))::INT - 1 AS new_place, CASE WHEN b - a + 1 >= 16 AND len(cut) > 0 THEN array_to_string(list_transform(list_sort(cut), lambda x: x[1] || '-' || x[2]), ',') END AS ranges, false AS fallback FROM m""",
)
def rerank_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest chunks in a reply's order, cut to the lines that it selects where they are long enough."""
    vectors = table(spark, sf_dir, "embeddings")
    top = vector.topk(vectors, vectors.where("vec_id = 0"), "vec_id", 10)
    # ten rows
    placed = top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "vec_id")) - 1)
    start = F.col("vec_id") % 3 + 1
    found = evaluation.reranked(placed.withColumns({"line_start": start, "line_end": start + F.col("vec_id") % 40}), _REPLY)
    shown = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string"))), ",")
    return found.select("vec_id", "new_place", shown.alias("ranges"), "fallback")


@query(
    "readiness_state",
    f"""{t.with_tables(t.FILE)}, s AS (SELECT repo, count(*) AS chunks, max(doc_id) % 7 = 0 AS mutating, max(doc_id) % 5 = 0 AS resolving, CASE WHEN max(doc_id) % 3 > 0 THEN max(doc_id) % 90000 END AS age FROM file GROUP BY repo)
        SELECT repo, CASE WHEN mutating OR chunks = 0 THEN 'wait' WHEN resolving THEN 'vectors_only' WHEN age IS NULL THEN 'serve_and_refresh' WHEN age > 600 THEN 'reindex' ELSE 'serve' END AS state FROM s""",
)
def readiness_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, last = F.timestamp_seconds(F.lit(1_700_000_000)), F.max("doc_id")
    age = F.when(last % 3 > 0, F.timestamp_seconds(1_700_000_000 - last % 90_000))
    status = t.files(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("chunks"), (last % 7 == 0).alias("mutating"), (last % 5 == 0).alias("resolving"), age.alias("indexed_at"))
    return evaluation.readiness(status, now, 600).select("repo", "state")


@query("kv_meta_json", "SELECT user_id, json_extract_string(arg_max(props, (ts, event_id)), '$.k')::INT AS k FROM events GROUP BY user_id")
def kv_meta_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value written under each key, read as JSON."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("props"))
    return last.select("user_id", F.from_json("props", "k int")["k"].alias("k"))


@query("index_stats", f"{t.with_tables(t.FILE, t.SYMBOL)} SELECT (SELECT count(*) FROM file) AS files, (SELECT count(*) FROM symbol) AS symbols, (SELECT count(*) FROM embeddings) AS vectors, (SELECT max(len(embedding)) FROM embeddings)::INT AS dim")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [t.files(spark, sf_dir).agg(F.count("*").alias("files")), t.symbols(spark, sf_dir).agg(F.count("*").alias("symbols")), table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dim"))]
    # tables of one row
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))


@query("file_chunks", "SELECT vec_id, label, len(embedding)::INT AS dim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 500")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file its first chunks, vectors reduced to their length."""
    order = Window.partitionBy("label").orderBy("vec_id")
    sized = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").alias("dim"))
    return sized.withColumn("r", F.row_number().over(order)).where("r <= 500").drop("r")


@query("numbered_lines", f"{t.with_tables(t.FILE, t.LINE)} SELECT file, md5(string_agg(ln || ': ' || body, chr(10) ORDER BY ln)) AS digest FROM line GROUP BY file")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.files(spark, sf_dir).select("file", F.md5(text.numbered(F.col("text"))).alias("digest"))


_SCRIPT = r"(?is)<script(?:\s[^>]*)?>(.*?)</script>"


@query("script_blocks", f"SELECT page_id, len(b)::INT AS blocks, md5(array_to_string(b, chr(10))) AS digest FROM (SELECT page_id, regexp_extract_all(html, '{_SCRIPT}', 1) AS b FROM pages)")
def script_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(_SCRIPT), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", found.alias("b")).select("page_id", F.size("b").alias("blocks"), F.md5(F.array_join("b", "\n")).alias("digest"))
