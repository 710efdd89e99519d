"""Queries that carry candidates to an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import answer, graph, lexical
from tessella.plans import graph_queries as g
from tessella.plans import interval_queries as i
from tessella.plans import search_queries as q
from tessella.plans.registry import query
from tessella.sources import engine_tables as t
from tessella.sources.shared import written
from tessella.sources.tables import table

#: The chunks of an even document k lie in function p:k+1, those of an odd one in one of a hundred traits, where there are such.
_OF = "CASE WHEN doc_id % 2 = 0 THEN 'p:' || (doc_id + 1) ELSE 's:' || (doc_id % 100 + 1) END"
_CHUNKS = f"WITH RECURSIVE {t.FILE}, {t.LINE}, {t.CHUNK}, {t.SYMBOL}"


def _fn() -> Column:
    key = F.col("doc_id")
    return F.when(key % 2 == 0, F.concat(F.lit("p:"), (key + 1).cast("string"))).otherwise(F.concat(F.lit("s:"), (key % 100 + 1).cast("string")))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return t.chunks(spark, d).withColumn("fqn", _fn())


@query(
    "hydrate_candidates",
    f"""{_CHUNKS}, firsts AS (SELECT doc_id, file, min(line_start) AS line_start, arg_min(line_end, line_start) AS line_end FROM chunk GROUP BY 1, 2),
        cand AS (SELECT file, line_start, CASE WHEN vec_id % 5 = 0 THEN line_end + 1 ELSE line_end END AS line_end, (vec_id % 101) / 101.0 AS score FROM embeddings JOIN firsts ON vec_id = doc_id),
        held AS (SELECT cand.*, content, {_OF} AS fqn FROM cand JOIN chunk USING (file, line_start, line_end) WHERE length(trim(content)) >= 1)
        SELECT held.file, held.line_start, round(score, 6) AS score, md5(content) AS digest, kind FROM held LEFT JOIN symbol USING (fqn)""",
)
def hydrate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's chunk and its symbol's kind; every fifth vector is of a chunk that is there no more, and goes."""
    chunks = _chunks(spark, sf_dir)
    firsts = chunks.groupBy("doc_id", "file").agg(F.min(F.struct("line_start", "line_end")).alias("c"))
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), ((F.col("vec_id") % 101) / 101.0).alias("score")).join(firsts, "doc_id")
    end = F.when(F.col("doc_id") % 5 == 0, F.col("c.line_end") + 1).otherwise(F.col("c.line_end"))
    candidates = found.select("file", "c.line_start", end.alias("line_end"), "score")
    return answer.hydrated(candidates, chunks, t.symbols(spark, sf_dir)).select("file", "line_start", F.round("score", 6).alias("score"), F.md5("content").alias("digest"), "kind")


_SHAPED = """shaped AS (SELECT file, line_start, line_end, pos, pos % 5 AS callers, CASE WHEN pos % 5 > 0 THEN ['a' || pos, 'b'] ELSE [] END AS caller_names, pos % 3 = 0 AS callers_inferred,
    CASE WHEN pos % 4 > 0 THEN pos % 4 END AS callees, ['c' || pos] AS callee_names, pos % 7 = 0 AS callees_inferred FROM spread)"""


def _adopted_sql(s: str) -> str:
    n = f"greatest(coalesce({s}s, 0), 0)"
    return f"max({n}) AS {s}s, arg_max({s}_names, ({n}, -k)) AS {s}_names, arg_max(k, ({n}, -k)) AS {s}_k"


@query(
    "block_adopt",
    f"""WITH {i.SPREAD}, {_SHAPED}, a AS (SELECT *, row_number() OVER o AS k, CASE WHEN line_start > max(line_end) OVER (PARTITION BY file ORDER BY line_start, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new
            FROM shaped WINDOW o AS (PARTITION BY file ORDER BY line_start, pos)),
        b AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY line_start, pos ROWS UNBOUNDED PRECEDING) AS island FROM a),
        top AS (SELECT file, island, {_adopted_sql("caller")}, {_adopted_sql("callee")} FROM b GROUP BY 1, 2)
        SELECT file, min(line_start)::INT AS line_start, max(line_end)::INT AS line_end, min(pos) AS pos, any_value(top.callers)::BIGINT AS callers, array_to_string(any_value(top.caller_names), ',') AS caller_names,
            bool_or(callers_inferred) FILTER (k >= caller_k) AS callers_inferred, any_value(top.callees)::BIGINT AS callees, array_to_string(any_value(top.callee_names), ',') AS callee_names, bool_or(callees_inferred) FILTER (k >= callee_k) AS callees_inferred
        FROM b JOIN top USING (file, island) GROUP BY file, island""",
)
def block_adopt(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, name = F.col("pos"), lambda mark: F.concat(F.lit(mark), F.col("pos").cast("string"))
    none = F.array().cast("array<string>")
    shaped = i.spread(spark, sf_dir).select(
        "file", "line_start", "line_end", "pos", (pos % 5).alias("callers"), F.when(pos % 5 > 0, F.array(name("a"), F.lit("b"))).otherwise(none).alias("caller_names"), (pos % 3 == 0).alias("callers_inferred"),
        F.when(pos % 4 > 0, pos % 4).alias("callees"), F.array(name("c")).alias("callee_names"), (pos % 7 == 0).alias("callees_inferred"),
    )
    joined = {f"{s}_names": F.array_join(f"{s}_names", ",") for s in ("caller", "callee")}
    return answer.adopted_blocks(shaped).withColumns(joined)


#: Names of a symbol's callers, the nearest first, and how many call sites there are.
_NEAR = r"CASE WHEN in_file = out_file THEN 0 WHEN regexp_replace(in_file, '/?[^/]*$', '') = regexp_replace(out_file, '/?[^/]*$', '') THEN 1 ELSE 2 END"


def _side_sql(p: str, at: str, to: str) -> str:
    return f"""{p}_n AS (SELECT {at} AS fqn, count(*) AS n, bool_or(coalesce(confidence, 1.0) < 1.0) AS inferred FROM calls GROUP BY 1),
        {p}_p AS (SELECT {at} AS fqn, name, min({_NEAR}) AS near FROM calls JOIN symbol s ON s.fqn = {to} GROUP BY 1, 2),
        {p}_l AS (SELECT fqn, list(name ORDER BY near, name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY near, name) AS r FROM {p}_p) WHERE r <= 30 GROUP BY fqn),
        {p} AS (SELECT fqn, ' [' || '{"callers" if p == "ca" else "calls"}: ' || array_to_string(names, ', ') || CASE WHEN n > len(names) THEN ' +' || (n - len(names)) || ' more' ELSE '' END || CASE WHEN inferred THEN ' ~inferred' ELSE '' END || ']' AS tag FROM {p}_n JOIN {p}_l USING (fqn))"""


_TAGS = f"{_side_sql('ca', 'out_name', 'in_name')}, {_side_sql('ce', 'in_name', 'out_name')}"


def _stats(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    return graph.call_lists(t.calls(spark, d), t.symbols(spark, d), of=of)


@query("call_tags", f"{g.CS[:-1]}, {_TAGS} SELECT fqn, coalesce(ca.tag, '') AS callers, coalesce(ce.tag, '') AS calls FROM ca FULL JOIN ce USING (fqn)")
def call_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The callers and callees of each symbol as an answer shows them."""
    s, none = _stats(spark, sf_dir), F.array().cast("array<string>")
    tags = [answer.tag(w, F.col(c), F.coalesce(n, none), F.col(inf)).alias(w) for w, c, n, inf in (("callers", "callers", "caller_names", "callers_inferred"), ("calls", "callees", "callee_names", "callees_inferred"))]
    return s.select("fqn", *tags)


@query(
    "symbol_context",
    f"""{g.CS[:-1]}, {_TAGS}, src AS (SELECT 'p:' || doc_id AS fqn, string_split(text, chr(10)) AS b, text FROM documents),
        cut AS (SELECT fqn, len(b) AS n, text, CASE WHEN len(b) > 200 OR length(text) > 16000 THEN left(array_to_string(b[1:200], chr(10)), 16000) ELSE text END AS shown FROM src)
        SELECT fqn, md5('`' || fqn || '` (' || kind || ') — ' || s.file || ':' || line_start || '-' || line_end || chr(10) ||
            CASE WHEN text IS NULL THEN chr(10) || '(no source)' ELSE chr(10) || shown || chr(10) || CASE WHEN shown <> text THEN chr(10) || '(cut, of ' || n || ' lines)' ELSE '' END END ||
            CASE WHEN ca.tag IS NULL AND ce.tag IS NULL THEN chr(10) || '(no calls known)' ELSE coalesce(chr(10) || ltrim(ca.tag), '') || coalesce(chr(10) || ltrim(ce.tag), '') END) AS digest
        FROM symbol s LEFT JOIN cut USING (fqn) LEFT JOIN ca USING (fqn) LEFT JOIN ce USING (fqn) WHERE kind = 'function'""",
)
def symbol_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer says of a function: its place, its text, its callers and callees."""
    functions = t.symbols(spark, sf_dir).where("kind = 'function'")
    source = table(spark, sf_dir, "documents").select(F.concat(F.lit("p:"), "doc_id").alias("fqn"), F.col("text").alias("content"))
    return answer.described(functions, source, _stats(spark, sf_dir, functions)).select("fqn", F.md5("text").alias("digest"))


#: Chunks that the graph adds: those of functions near the ones that the fused list's chunks lie in.
_GROWN = f"""base AS (SELECT file, line_start, line_end, round(score, 6) AS score FROM fused ORDER BY round(rrf, 9) DESC, vrank NULLS LAST, lrank NULLS LAST, file LIMIT 20), {t.CALLS},
    s AS (SELECT {_OF} AS fqn, max(score) AS score FROM base JOIN chunk USING (file, line_start, line_end) GROUP BY 1), {g.EXPANDED},
    more AS (SELECT file, f.line_start, f.line_end, bonus.score FROM bonus JOIN firsts f ON {_OF} = bonus.fqn),
    every AS (SELECT *, true AS base FROM base UNION ALL SELECT *, false FROM more), cands AS (SELECT file, line_start, line_end, max(score) AS score, bool_or(base) AS base FROM every GROUP BY 1, 2, 3)"""


def _grown(spark: SparkSession, d: str) -> DataFrame:
    """The fused list and what the graph adds to it, each chunk once with its best score.

    Both are short, and much is read for them: they are written."""
    base = written(q.fused(spark, d).orderBy(*lexical.fused_order()).limit(20).select(*answer.KEY, F.round("score", 6).alias("score")), "base")
    chunks = _chunks(spark, d)
    seeds = base.join(chunks, list(answer.KEY)).groupBy("fqn").agg(F.max("score").alias("score"))
    bonus = graph.expand(t.calls(spark, d), seeds)
    firsts = chunks.groupBy("fqn", "file").agg(F.min(F.struct("line_start", "line_end")).alias("c")).select("fqn", "file", "c.line_start", "c.line_end")
    return written(answer.united(base, bonus.join(firsts, "fqn")), "grown")


@query("candidates_united", f"{q.LISTS}, {_GROWN} SELECT file, line_start, line_end, round(score, 6) AS score, base FROM cands")
def candidates_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grown(spark, sf_dir).withColumn("score", F.round("score", 6))


#: An answer of 6000 characters, so that its end is seen.
_BUDGET = 6000


@query(
    "search_answer",
    f"""{q.LISTS}, {_GROWN}, u AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_start, line_end) AS k FROM cands),
        walk AS (SELECT file, k, 1 AS grp, line_start AS a, line_end AS b FROM u WHERE k = 1
              UNION ALL SELECT u.file, u.k, CASE WHEN u.line_start <= walk.b + 2 AND greatest(walk.b, u.line_end) - walk.a + 1 <= 60 THEN walk.grp ELSE walk.grp + 1 END,
              CASE WHEN u.line_start <= walk.b + 2 AND greatest(walk.b, u.line_end) - walk.a + 1 <= 60 THEN walk.a ELSE u.line_start END, CASE WHEN u.line_start <= walk.b + 2 AND greatest(walk.b, u.line_end) - walk.a + 1 <= 60 THEN greatest(walk.b, u.line_end) ELSE u.line_end END
              FROM walk JOIN u ON u.file = walk.file AND u.k = walk.k + 1),
        m AS (SELECT walk.file, walk.a AS line_start, max(walk.b) AS line_end, round(max(score), 6) AS score FROM walk JOIN u USING (file, k) GROUP BY walk.file, grp, walk.a),
        shown AS (SELECT m.*, array_to_string(list_transform(generate_series(line_start, line_end), lambda n: n || ': ' || string_split({q.redact_sql("text")}, chr(10))[n]), chr(10)) AS body FROM m JOIN file USING (file)
            WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.file = m.file AND o.line_start <= m.line_start AND o.line_end >= m.line_end AND (o.line_start, o.line_end) <> (m.line_start, m.line_end))),
        placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, file, line_start)::INT AS place, sum(length(body)) OVER (ORDER BY score DESC, file, line_start ROWS UNBOUNDED PRECEDING) <= {_BUDGET} AS whole FROM shown)
        SELECT place, file, line_start::INT AS line_start, line_end::INT AS line_end, score, whole, md5(CASE WHEN whole THEN body ELSE split_part(body, chr(10), 1) END) AS digest FROM placed""",
)
def search_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole retrieval: vectors and words fused, the graph's neighbours added, ranges merged, secrets taken out of the text,
    lines numbered; blocks are whole while the answer has room, then their first lines."""
    ranges = answer.merged(_grown(spark, sf_dir)).withColumn("score", F.round("score", 6))
    lines = F.slice(F.split(text.redacted(F.col("text")), "\n"), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1)
    body = text.numbered(F.array_join(lines, "\n"), F.col("line_start"))
    shown = ranges.join(t.files(spark, sf_dir).select("file", "text"), "file").select(*answer.KEY, "score", body.alias("body"))
    best = [F.desc("score"), F.col("file"), F.col("line_start")]
    # 50 ranges at most: the fused list's and the graph's
    whole = answer.within(shown.withColumn("answer", F.lit(1)), "answer", best, F.length("body"), _BUDGET)
    text_ = F.when(F.col("whole"), F.col("body")).otherwise(F.substring_index("body", "\n", 1))
    return whole.select(F.row_number().over(Window.partitionBy("answer").orderBy(*best)).alias("place"), *answer.KEY, "score", "whole", F.md5(text_).alias("digest"))
