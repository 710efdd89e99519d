"""Queries over lines and line ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import graph, intervals
from tessella.plans.registry import query
from tessella.sources import engine_tables as t
from tessella.sources.tables import table

_L = t.with_tables(t.FILE, t.LINE)
_NS = r"length(regexp_replace(body, '\s+', '', 'g'))"


@query("line_table", f"{_L} SELECT file, ln, md5(body) AS digest FROM line")
def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.lines(t.files(spark, sf_dir)).select("file", "ln", F.md5("body").alias("digest"))


@query("nonws_prefix", f"{_L} SELECT file, ln, (sum({_NS}) OVER (PARTITION BY file ORDER BY ln ROWS UNBOUNDED PRECEDING))::BIGINT AS chars FROM line")
def nonws_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length(F.regexp_replace("body", r"\s+", ""))
    return t.lines(t.files(spark, sf_dir)).select("file", "ln", F.sum(size).over(Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)).alias("chars"))


@query(
    "chunk_lines",
    f"WITH RECURSIVE {t.FILE}, {t.LINE}, {t.CHUNK} SELECT file, line_start, line_end, size FROM packed",
)
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = t.files(spark, sf_dir).select("file", F.explode(intervals.packed_lines(F.split("text", "\n"))).alias("c"))
    return packed.select("file", "c.line_start", "c.line_end", "c.size")


_P = t.with_tables(t.SYMBOL)[:-1] + ", sym AS (SELECT * FROM symbol WHERE kind = 'function'), ch AS (SELECT DISTINCT file, greatest(line_start - 3, 1)::INT AS line_start, (line_start + 12)::INT AS line_end FROM sym)"


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    """Functions, the symbols that lie in source files."""
    return t.symbols(spark, d).where("kind = 'function'")


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("line_start")
    return _symbols(spark, d).select("file", F.greatest(start - 3, F.lit(1)).alias("line_start"), (start + 12).alias("line_end")).distinct()


@query("interval_overlap_join", f"{_P} SELECT ch.file, ch.line_start, ch.line_end, fqn FROM ch JOIN sym s ON s.file = ch.file AND s.line_start <= ch.line_end AND s.line_end >= ch.line_start")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlapping(_ranges(spark, sf_dir), _symbols(spark, sf_dir)).select("file", "line_start", "line_end", F.col("r_fqn").alias("fqn"))


_INNER = "inn AS (SELECT DISTINCT file, (line_start + 2)::INT AS line_start, (line_start + 6)::INT AS line_end FROM sym)"


@query(
    "deepest_enclosing",
    f"""{_P}, {_INNER} SELECT i.file, i.line_start, i.line_end, arg_min(fqn, (s.line_end - s.line_start, -s.line_start, fqn)) AS fqn
        FROM inn i LEFT JOIN sym s ON s.file = i.file AND s.line_start <= i.line_start AND s.line_end >= i.line_end GROUP BY ALL""",
)
def deepest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    inner = s.select("file", (F.col("line_start") + 2).alias("line_start"), (F.col("line_start") + 6).alias("line_end")).distinct()
    return intervals.deepest(inner, s)


@query("first_overlap", f"{_P} SELECT fqn, s.file, arg_min(ch.line_start, (ch.line_start, ch.line_end)) AS chunk_start, arg_min(ch.line_end, (ch.line_start, ch.line_end)) AS chunk_end FROM sym s JOIN ch ON s.file = ch.file AND s.line_start <= ch.line_end AND s.line_end >= ch.line_start GROUP BY ALL")
def first_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.first_overlap(_symbols(spark, sf_dir), _ranges(spark, sf_dir))


_ISLAND = """{n}_a AS (SELECT *, CASE WHEN line_start > max(line_end) OVER (PARTITION BY file ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS new FROM {src}),
    {n}_b AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY line_start, line_end ROWS UNBOUNDED PRECEDING) AS island FROM {n}_a),
    {n} AS (SELECT file, min(line_start)::INT AS line_start, max(line_end)::INT AS line_end, count(*) AS n, min(pos) AS pos FROM {n}_b GROUP BY file, island)"""
#: Ranges of ten lines around each symbol of a file, many of which touch.
SPREAD = "spread AS (SELECT 'f' || (p_partkey % 40) AS file, (p_partkey * 37 % 5000 + 1)::INT AS line_start, (p_partkey * 37 % 5000 + 1 + p_size)::INT AS line_end, p_partkey AS pos, (p_partkey % 97) / 97.0 AS score FROM part)"
_SP = f"WITH {SPREAD}"


def spread(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    start = (key * 37 % 5000 + 1).cast("int")
    return table(spark, d, "part").select(F.concat(F.lit("f"), key % 40).alias("file"), start.alias("line_start"), (start + F.col("p_size")).alias("line_end"), key.alias("pos"), ((key % 97) / 97.0).alias("score"))


@query("merge_gap_islands", f"{_SP}, {_ISLAND.format(n='m', gap=2, src='spread')} SELECT file, line_start, line_end, n FROM m")
def merge_gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(spread(spark, sf_dir), 2, n=F.count("*"))


@query("block_merge", f"{_SP}, {_ISLAND.format(n='m', gap=1, src='spread')} SELECT file, line_start, line_end, pos FROM m")
def block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(spread(spark, sf_dir), 1, pos=F.min("pos"))


_PADDED = "padded AS (SELECT file, greatest(line_start - 2, 1)::INT AS line_start, least(line_end + 2, 4000)::INT AS line_end, pos FROM spread WHERE line_start <= 4000)"


@query("range_sanitize", f"{_SP}, {_PADDED}, {_ISLAND.format(n='m', gap=1, src='padded')} SELECT file, line_start, line_end FROM m")
def range_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a file of 4000 lines: padded by two, cut to the file, merged if they touch."""
    valid = spread(spark, sf_dir).where("line_start <= 4000")
    padded = valid.select("file", F.greatest(F.col("line_start") - 2, F.lit(1)).alias("line_start"), F.least(F.col("line_end") + 2, F.lit(4000)).alias("line_end"))
    return intervals.islands(padded, 1)


_GREP = r"hit AS (SELECT file, ln, count(*) OVER (PARTITION BY file) AS total FROM line WHERE regexp_matches(body, '(token|secret|license)'))"


@query("grep_regions", f"{_L[:-1]}, {_GREP}, src AS (SELECT file, greatest(ln - 1, 1)::INT AS line_start, (ln + 1)::INT AS line_end, ln AS pos FROM hit), {_ISLAND.format(n='m', gap=1, src='src')} SELECT file, line_start, line_end, n FROM m")
def grep_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching lines with one line around them, as regions."""
    hits = t.lines(t.files(spark, sf_dir)).where(F.col("body").rlike("(token|secret|license)"))
    return intervals.islands(hits.select("file", F.greatest(F.col("ln") - 1, F.lit(1)).alias("line_start"), (F.col("ln") + 1).alias("line_end")), 1, n=F.count("*"))


_CAPPED = f"""WITH RECURSIVE {SPREAD}, u AS (SELECT file, line_start, line_end, max(score) AS score FROM spread GROUP BY 1, 2, 3), s AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_start, line_end) AS k FROM u),
    r AS (SELECT file, k, 1 AS grp, line_start AS a, line_end AS b FROM s WHERE k = 1
          UNION ALL SELECT s.file, s.k, CASE WHEN s.line_start <= r.b + 2 AND greatest(r.b, s.line_end) - r.a + 1 <= 60 THEN r.grp ELSE r.grp + 1 END,
          CASE WHEN s.line_start <= r.b + 2 AND greatest(r.b, s.line_end) - r.a + 1 <= 60 THEN r.a ELSE s.line_start END, CASE WHEN s.line_start <= r.b + 2 AND greatest(r.b, s.line_end) - r.a + 1 <= 60 THEN greatest(r.b, s.line_end) ELSE s.line_end END
          FROM r JOIN s ON s.file = r.file AND s.k = r.k + 1),
    merged AS (SELECT r.file, a::INT AS line_start, max(b)::INT AS line_end, round(max(score), 6) AS score FROM r JOIN s USING (file, k) GROUP BY r.file, grp, a)"""


@query("merge_capped_60", f"{_CAPPED} SELECT * FROM merged")
def merge_capped_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged_capped(spread(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("drop_contained", f"{_SP}, u AS (SELECT DISTINCT file, line_start, line_end FROM spread) SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u w WHERE w.file = u.file AND w.line_start <= u.line_start AND w.line_end >= u.line_end AND (w.line_start, w.line_end) <> (u.line_start, u.line_end))")
def drop_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.without_contained(spread(spark, sf_dir).select("file", "line_start", "line_end").distinct())


_DIFF = """body AS (SELECT doc_id, unnest(generate_series(1, len(b))) AS n, unnest(b) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS b FROM documents)),
    what AS (SELECT doc_id, n, CASE (n * 7 + doc_id) % 5 WHEN 0 THEN '-' WHEN 1 THEN '+' WHEN 2 THEN '+' ELSE ' ' END AS w FROM body),
    placed AS (SELECT *, 11 + coalesce(sum(CASE WHEN w <> '-' THEN 1 ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ln, sum(CASE WHEN w = ' ' THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS run FROM what WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
    runs AS (SELECT doc_id AS diff, 'pkg/b' || (doc_id % 25 + 1) || '/m' || (doc_id % 7) || '.py' AS file, min(ln)::INT AS line_start, max(ln)::INT AS line_end FROM placed WHERE w = '+' GROUP BY doc_id, run)"""


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """A diff of one file for each document: its lines as added, deleted or context."""
    key = F.col("doc_id")
    mark = F.when((F.col("k") * 7 + 7 + key) % 5 == 0, "-").when(((F.col("k") * 7 + 7 + key) % 5).isin(1, 2), "+").otherwise(" ")
    body = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "x")).select(key.alias("diff"), (F.col("k") + 3).alias("n"), F.concat(mark, "x").alias("body"))
    file = F.concat(F.lit("pkg/b"), (key % 25 + 1).cast("string"), F.lit("/m"), (key % 7).cast("string"), F.lit(".py"))
    heads = F.array(F.concat(F.lit("--- a/"), file), F.concat(F.lit("+++ b/"), file), F.lit("@@ -1,9 +11,9 @@ f"))
    return table(spark, d, "documents").select(key.alias("diff"), F.posexplode(heads).alias("n", "body")).unionByName(body)


@query("diff_added_runs", f"WITH {_DIFF} SELECT * FROM runs")
def diff_added_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.added_runs(_diffs(spark, sf_dir))


_CHANGED = f"hull AS (SELECT file, min(line_start) AS a, max(line_end) AS b FROM runs GROUP BY file), ch AS (SELECT fqn, s.file FROM symbol s JOIN hull h ON s.file = h.file AND s.line_start <= b AND s.line_end >= a)"


@query("changed_symbols", f"WITH {t.SYMBOL}, {_DIFF}, {_CHANGED} SELECT fqn, file FROM ch")
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.changed_symbols(intervals.added_runs(_diffs(spark, sf_dir)), t.symbols(spark, sf_dir)).select("fqn", "file")


@query(
    "changes_impact",
    f"""WITH RECURSIVE {t.SYMBOL}, {t.CALLS}, {_DIFF}, {_CHANGED}, e AS (SELECT DISTINCT in_name, out_name FROM calls),
        r AS (SELECT DISTINCT fqn, 0 AS depth FROM ch UNION SELECT e.in_name, r.depth + 1 FROM r JOIN e ON e.out_name = r.fqn WHERE r.depth < 2)
        SELECT fqn, min(depth)::INT AS depth FROM r GROUP BY fqn HAVING min(depth) > 0""",
)
def changes_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reaches any changed symbol within two hops: all of them are one seed."""
    changed = intervals.changed_symbols(intervals.added_runs(_diffs(spark, sf_dir)), t.symbols(spark, sf_dir)).select("fqn").distinct()
    return graph.reached(t.calls(spark, sf_dir), changed, 2)


@query("grep_lines", f"{_L[:-1]}, {_GREP} SELECT file, ln FROM hit ORDER BY file, ln LIMIT 200")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.lines(t.files(spark, sf_dir)).where(F.col("body").rlike("(token|secret|license)")).select("file", "ln").orderBy("file", "ln").limit(200)


@query("grep_per_file_cap", f"{_L} SELECT file, ln FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ln) AS r FROM line WHERE contains(lower(body), 'th')) WHERE r <= 20")
def grep_per_file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = t.lines(t.files(spark, sf_dir)).where(F.contains(F.lower("body"), F.lit("th")))
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("ln"))).where("r <= 20").select("file", "ln")


@query("read_range_budget", f"{_L} SELECT file, ln FROM (SELECT file, ln, sum(strlen(body) + 1) OVER (PARTITION BY file ORDER BY ln ROWS UNBOUNDED PRECEDING) AS upto FROM line WHERE ln BETWEEN 2 AND 801) WHERE upto <= 65536")
def read_range_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 801 of each file, while their bytes fit into 64 KiB."""
    lines = t.lines(t.files(spark, sf_dir)).where("ln between 2 and 801")
    upto = F.sum(F.octet_length("body") + 1).over(Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("upto", upto).where("upto <= 65536").select("file", "ln")
