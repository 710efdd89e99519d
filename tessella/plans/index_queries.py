"""Queries of an index's life: incremental runs, stamps, shards, caches, batches, and what a server keeps beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths, text
from tessella.operators import index, vector
from tessella.plans.registry import query
from tessella.sources import engine_tables as t
from tessella.sources.shared import new_path
from tessella.sources.tables import table



@query(
    "incremental_index",
    f"""WITH {t.FILE}, final AS (SELECT file, CASE WHEN doc_id % 7 = 0 THEN 'edited ' || text ELSE text END AS text FROM file WHERE doc_id % 11 <> 0),
        l AS (SELECT file, unnest(generate_series(1, len(b)))::INT AS ln, unnest(b) AS body FROM (SELECT file, string_split(text, chr(10)) AS b FROM final)) SELECT file, ln, md5(body) AS digest FROM l""",
)
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of lines after three runs: most files; then some that are new, some changed and some gone, where the first try
    breaks off before its commit and is repeated; and a run that is sent twice."""
    files = t.files(spark, sf_dir)
    rows = lambda f: t.lines(f).select("file", "ln", F.md5("body").alias("digest"))
    touched = lambda f, deleted: f.select("file", F.lit(deleted).alias("deleted"))
    first, late = files.where("doc_id % 5 <> 3"), files.where("doc_id % 5 = 3")
    own = index.Index(spark, new_path(spark, "index"))
    own.apply("build", "local", touched(first, False), {"line": rows(first)})
    gone, changed = first.where("doc_id % 11 = 0"), first.where("doc_id % 11 <> 0 AND doc_id % 7 = 0")
    fresh = late.where("doc_id % 11 <> 0 AND doc_id % 7 <> 0").unionByName(changed.withColumn("text", F.concat(F.lit("edited "), "text")))
    wrong = fresh.withColumn("text", F.lit("what a crashed run read"))
    every = touched(fresh, False).unionByName(touched(gone, True))

    def broken() -> None:
        raise InterruptedError

    try:
        own.apply("edit", "local", every, {"line": rows(wrong)}, broken)
    except InterruptedError:
        pass
    own.apply("edit", "local", every, {"line": rows(fresh)})
    last = late.where("doc_id % 11 <> 0 AND doc_id % 7 = 0").withColumn("text", F.concat(F.lit("edited "), "text"))
    for _ in range(2):
        own.apply("more", "local", touched(last, False), {"line": rows(last)})
    return own.read("line").select("file", "ln", "digest")


_KEY = index.identity_key("onnx", "small-code", 64)
_STAMP = "((n::HUGEINT * 1099511628211 + ('0x' || array_to_string(list_transform(generate_series(0, 7), lambda k: substr(sha256('{key}'), 15 - 2 * k, 2)), ''))::UBIGINT::HUGEINT) % 18446744073709551616)::VARCHAR"


@query("content_stamps", f"SELECT source AS repo, n AS chunks, {_STAMP.format(key=_KEY)} AS stamp FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def content_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo")).agg(F.count("*").alias("chunks"))
    return counts.withColumn("stamp", index.content_stamp(F.col("chunks"), F.lit(_KEY)))


@query("shard_states", "SELECT source AS repo, CASE WHEN n = 0 THEN 'none' WHEN k % 4 = 0 THEN 'cold' WHEN k % 4 IN (1, 2) THEN 'mismatch' ELSE 'warm' END AS state FROM (SELECT source, count(*) FILTER (lang <> 'es' OR k % 5 <> 0) AS n, k FROM (SELECT *, regexp_extract(source, '([0-9]+)$', 1)::INT AS k FROM documents) GROUP BY source, k)")
def shard_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fourth of the repos has no shard, one a shard of fewer chunks, one a shard of another embedder."""
    k = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo"), k.alias("k")).agg(F.count_if((F.col("lang") != "es") | (k % 5 != 0)).alias("chunks"))
    shards = counts.where("k % 4 <> 0").select("repo", index.content_stamp(F.col("chunks") - F.when(F.col("k") % 4 == 1, 1).otherwise(0), F.when(F.col("k") % 4 == 2, index.identity_key("hosted", "other", None)).otherwise(_KEY)).alias("stamp"))
    return index.shard_states(shards, counts.select("repo", "chunks"), _KEY)


@query(
    "scoped_search",
    """WITH s AS (SELECT label, CASE WHEN label % 4 = 0 THEN 'cold' WHEN label % 4 IN (1, 2) THEN 'mismatch' ELSE 'warm' END AS state FROM (SELECT DISTINCT label FROM embeddings)),
        r AS (SELECT e.label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings e JOIN s USING (label) WHERE state = 'warm'),
        k AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS n FROM r QUALIFY n <= 15)
       SELECT 'hit' AS state, label, vec_id, score FROM k UNION ALL SELECT state, label, NULL, NULL FROM s WHERE state <> 'warm'""",
)
def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over the repos whose shards can be used, and a row for each of those that can't, which says why."""
    v = table(spark, sf_dir, "embeddings")
    counts = v.groupBy(F.col("label").alias("repo")).agg(F.count("*").alias("chunks"))
    k = F.col("repo") % 4
    shards = counts.where(k != 0).select("repo", index.content_stamp(F.col("chunks") + F.when(k == 1, 1).otherwise(0), F.when(k == 2, index.identity_key("hosted", "other", 8)).otherwise(_KEY)).alias("stamp"))
    states = index.shard_states(shards, counts, _KEY)
    probe = v.where("vec_id = 0").select(F.lit(0).alias("query_id"), "embedding")
    warm = v.join(states.where("state = 'warm'").select(F.col("repo").alias("label")), "label", "left_semi")
    hits = vector.topk(warm, probe, "vec_id", 15).select(F.lit("hit").alias("state"), "label", "vec_id", "score")
    return hits.unionByName(states.where("state <> 'warm'").select("state", F.col("repo").alias("label"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("double").alias("score")))


@query("shard_eviction", """WITH s AS (SELECT source AS repo, sum(n_chars)::BIGINT AS bytes, max(doc_id) AS used_at, bool_or(doc_id % 97 = 0) AS active FROM documents GROUP BY source),
    h AS (SELECT *, sum(bytes) OVER (ORDER BY active DESC, used_at DESC, repo ROWS UNBOUNDED PRECEDING) AS held FROM s) SELECT repo, bytes, active FROM h WHERE active OR held <= (SELECT sum(bytes) / 2 FROM s)""")
def shard_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all bytes may stay: shards in use, then the last used ones."""
    shards = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo")).agg(F.sum("n_chars").alias("bytes"), F.max("doc_id").alias("used_at"), F.bool_or(F.col("doc_id") % 97 == 0).alias("active"))
    cap = shards.agg(F.sum("bytes").alias("b")).first()["b"] / 2
    return index.evicted(shards, cap).select("repo", "bytes", "active")


@query(
    "embedding_cache",
    """WITH c AS (SELECT vec_id, label, 'text ' || vec_id AS content, vec_id % 6 AS k FROM embeddings)
       SELECT label, count(*) FILTER (k IN (0, 5)) AS hits, count(*) FILTER (k NOT IN (0, 5)) AS misses FROM c GROUP BY label""",
)
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of six texts one is cached, one was cached anew, one's vector is of another model, one's is cut off, one's is too old, and one's is empty."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.concat(F.lit("text "), "vec_id").alias("content"), (F.col("vec_id") % 6).alias("k"), F.col("embedding").alias("vector"))
    day = lambda n: F.timestamp_seconds(F.lit(1_700_000_000) + n * 86_400)
    kept = F.when(F.col("k") == 2, F.slice("vector", 1, 10)).otherwise(F.col("vector"))
    old = v.where("k IN (0, 1, 2, 3, 5)").select(F.when(F.col("k") == 1, "other").otherwise(_KEY).alias("identity"), F.md5("content").alias("digest"), kept.alias("vector"), F.when(F.col("k") == 3, day(F.lit(0))).otherwise(day(F.lit(40))).alias("used_at"))
    fresh = v.where("k IN (4, 5)").select(F.md5("content").alias("digest"), F.when(F.col("k") == 4, F.slice("vector", 1, 0)).otherwise(F.col("vector")).alias("vector"))
    cache = index.purged(index.stored(old, fresh, _KEY, day(F.lit(50))), day(F.lit(60)), 30 * 86_400)
    path = new_path(spark, "vectors")
    index.write_cache(cache, path)
    found = index.cached(v.select("label", "content"), spark.read.parquet(path), _KEY, 64)
    return found.groupBy("label").agg(F.count("vector").alias("hits"), F.count_if(F.col("vector").isNull()).alias("misses"))


_BATCH_ROWS, _BATCH_BYTES = 16, 16_384


@query(
    "embed_batches",
    f"""WITH RECURSIVE d AS (SELECT source, doc_id, coalesce(strlen(text), 0) AS bytes, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
        r AS (SELECT source, doc_id, k, 0 AS batch, 1 AS n, bytes AS total FROM d WHERE k = 1
              UNION ALL SELECT d.source, d.doc_id, d.k, CASE WHEN r.n >= {_BATCH_ROWS} OR r.total + d.bytes > {_BATCH_BYTES} THEN r.batch + 1 ELSE r.batch END,
                CASE WHEN r.n >= {_BATCH_ROWS} OR r.total + d.bytes > {_BATCH_BYTES} THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= {_BATCH_ROWS} OR r.total + d.bytes > {_BATCH_BYTES} THEN d.bytes ELSE r.total + d.bytes END
              FROM r JOIN d ON d.source = r.source AND d.k = r.k + 1)
        SELECT source, doc_id, batch::BIGINT AS batch FROM r""",
)
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a batch of its source, of 16 texts and 16 KiB at most; the usual bounds are 128 and 1.5 MB."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return vector.batches(docs, "source", ["doc_id"], _BATCH_ROWS, _BATCH_BYTES).select("source", "doc_id", "batch")


@query("packed_vectors", "SELECT vec_id, len(embedding)::INT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as bytes and back."""
    back = vector.unpacked(vector.packed(table(spark, sf_dir, "embeddings")))
    return back.select("vec_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("vector_increment", "SELECT vec_id, label, CASE WHEN vec_id % 7 = 0 THEN round(-embedding[1]::DOUBLE, 6) ELSE round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings WHERE label <> 4 AND vec_id % 5 <> 0 AND NOT (vec_id % 7 = 0 AND vec_id % 3 = 0)")
def vector_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repo is taken out, files are removed, and others get new vectors, of which a third has the wrong dimension."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    left = vector.without(vector.without(v, spark.createDataFrame([(4,)], "label int"), ["label"]), v.where("vec_id % 5 = 0"), ["vec_id"])
    touched = left.where("vec_id % 7 = 0")
    turned = F.transform("embedding", lambda x: -x)
    fresh = touched.withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.slice(turned, 1, 8)).otherwise(turned))
    return vector.replaced(left, fresh, touched, 64, ["vec_id"]).select("vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


#: Messages, and how many searches each asks for.
_ASKED = (
    ("search 3 times for it", 3), ("please search at least four times", 4), ("do 5 searches", 5), ("fix bug 3", None), ("search for bug 12 in module", None), ("run 12 queries now", 7), ("search twice", None), ("search two times, then 6 times", 6),
    ("tìm 3 lần", 3), ("tìm bốn lần nhé", 4), ("搜索 三 次", 3), ("query 0 times", None), ("no number in this search", None), ("seven searches", 7),
)
_ASKED_SQL = ", ".join(f"({k}, {'NULL' if n is None else n})" for k, (_, n) in enumerate(_ASKED))


@query("requested_searches", f"SELECT event_id, n::INT AS searches FROM events JOIN (VALUES {_ASKED_SQL}) v(k, n) ON event_id % {len(_ASKED)} = k")
def requested_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.element_at(F.lit([m for m, _ in _ASKED]), (F.col("event_id") % len(_ASKED) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.requested_searches(message).alias("searches"))


@query(
    "result_summary",
    f"""{t.with_tables(t.SYMBOL)}, s AS (SELECT file, name, fqn, row_number() OVER (PARTITION BY file ORDER BY fqn) AS r, file || '#L' || line_start || '-' || line_end AS place FROM symbol WHERE kind = 'function')
        SELECT file, md5('search: ' || file || chr(10) || string_agg('- ' || place || CASE WHEN fqn LIKE '%3' THEN '' ELSE '  (1: ' || name || CASE WHEN fqn LIKE '%5' THEN left(repeat('x', 100), 77 - length(name)) || '…' ELSE '' END || ')' END, chr(10) ORDER BY r)) AS digest
        FROM s WHERE r <= 8 GROUP BY file""",
)
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's functions as one search's output, then as a summary: eight places with their first lines, which are cut if they are long."""
    s = t.symbols(spark, sf_dir).where("kind = 'function'")
    line = F.when(F.col("fqn").endswith("3"), "").when(F.col("fqn").endswith("5"), F.concat(F.lit("1: "), "name", F.lit("x" * 100))).otherwise(F.concat(F.lit("1: "), "name"))
    block = F.concat("file", F.lit("#L"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("\n  "), line, F.lit("\n2: more\n"))
    # a file's functions are few; the list is put in order before it is joined
    output = s.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fqn", block.alias("b")))), lambda x: x["b"]), "\n").alias("out"))
    return output.select("file", F.md5(text.result_summary(F.col("file"), F.col("out"))).alias("digest"))


@query(
    "truncated_texts",
    """WITH b AS (SELECT doc_id, text, string_split(text, chr(10)) AS b FROM documents)
       SELECT doc_id, md5(CASE WHEN len(b) > 7 THEN array_to_string(b[1:3], chr(10)) || chr(10) || '... (' || (len(b) - 7) || ' lines left out) ...' || chr(10) || array_to_string(b[-3:], chr(10)) ELSE text END) AS lines,
              md5(list_max(list_filter(list_transform(generate_series(0, 50), lambda k: left(text, k)), lambda p: strlen(p) <= 50))) AS bytes, md5(CASE WHEN length(trim(b[1])) > 40 THEN left(trim(b[1]), 40) || '…' ELSE trim(b[1]) END) AS shown FROM b""",
)
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(c).alias(n) for n, c in (("lines", text.truncated_lines(body, 7)), ("bytes", text.truncated_bytes(body, 50)), ("shown", text.preview(body, 40)))])


#: Paths that a reader may ask for, and what they come down to; null where they are refused.
_PATHS = (("a/b.py", "a/b.py"), ("./a//b.py", "a/b.py"), ("a/../b.py", "b.py"), ("../b.py", None), ("a/../../b.py", None), ("/etc/x", None), ("C:/x", None), ("a\\b.py", "a/b.py"), ("\\x", None), ("a/..", None), ("", None))
_PATHS_SQL = ", ".join(f"('{p}', {'NULL' if out is None else repr(out)})" for p, out in _PATHS)


@query("path_guard", f"SELECT source || '|' || p AS path, o AS safe FROM (SELECT DISTINCT source FROM documents), (VALUES {_PATHS_SQL}) v(p, o)")
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("source").distinct().select("source", F.explode(F.lit([p for p, _ in _PATHS])).alias("p"))
    return asked.select(F.concat_ws("|", "source", "p").alias("path"), paths.guarded(F.col("p")).alias("safe"))


@query("stage_timings", "SELECT event_type AS stage, count(*) AS runs, round(sum(value), 3) AS seconds, round(max(value), 3) AS longest FROM events GROUP BY event_type")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stages of runs, their values as seconds."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("runs"), F.round(F.sum("value"), 3).alias("seconds"), F.round(F.max("value"), 3).alias("longest"))


@query("from_file_page", f"{t.with_tables(t.RAW_EDGE)} SELECT from_file, count(*) AS edges FROM raw_edge WHERE from_file > 'pkg/b12/m3.py' GROUP BY from_file ORDER BY from_file LIMIT 40")
def from_file_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the files that edges come from, after a file."""
    after = t.raw_edges(spark, sf_dir).where(F.col("from_file") > "pkg/b12/m3.py")
    return after.groupBy("from_file").agg(F.count("*").alias("edges")).orderBy("from_file").limit(40)


@query("edge_page", f"{t.with_tables(t.RAW_EDGE)} SELECT from_file, edge_id FROM raw_edge WHERE (from_file, edge_id) > ('pkg/b12/m3.py', '3') ORDER BY from_file, edge_id LIMIT 100")
def edge_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of edges after a file and an edge."""
    later = (F.col("from_file") > "pkg/b12/m3.py") | ((F.col("from_file") == "pkg/b12/m3.py") & (F.col("edge_id") > "3"))
    return t.raw_edges(spark, sf_dir).where(later).select("from_file", "edge_id").orderBy("from_file", "edge_id").limit(100)


@query("point_lookups", f"{t.with_tables(t.SYMBOL)} SELECT 'fqn' AS asked, fqn FROM symbol WHERE fqn = 'p:7' UNION ALL SELECT 'file', fqn FROM symbol WHERE file = 'r:1' UNION ALL SELECT 'names', fqn FROM symbol WHERE name IN ('red ring', 'blue widget')")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by fqn, by file, and by a list of names."""
    s = t.symbols(spark, sf_dir)
    asked = (("fqn", F.col("fqn") == "p:7"), ("file", F.col("file") == "r:1"), ("names", F.col("name").isin("red ring", "blue widget")))
    found = [s.where(c).select(F.lit(n).alias("asked"), "fqn") for n, c in asked]
    return found[0].unionByName(found[1]).unionByName(found[2])
