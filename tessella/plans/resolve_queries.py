"""Queries of reference resolution, imports and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import non_space
from tessella.operators import incremental, resolve
from tessella.plans.registry import query
from tessella.sources import engine_tables as t
from tessella.sources.shared import written
from tessella.sources.tables import table

_MADE = r"regexp_matches(s.file, '(_pb2|_pb2_grpc|_generated)\.py$')"
_DIR = "regexp_replace({}, '/?[^/]*$', '')"


def _resolve_sql(edges: str = "raw_edge") -> str:
    dotted = "replace(import_path, '.', '/')"
    return f"""cand AS (SELECT e.*, s.fqn, s.file, s.line_start, s.line_end, {_MADE} AS made,
            CASE WHEN ends_with(s.file, {dotted} || '.py') THEN 0 WHEN ends_with(s.file, {dotted} || '/__init__.py') THEN 1 WHEN ends_with(s.file, {dotted}) THEN 2 END AS hit0
            FROM {edges} e JOIN symbol s ON s.name = e.to_name WHERE NOT starts_with(to_name, 'taint:')),
        lev AS (SELECT *, CASE WHEN import_path IS NOT NULL AND hit0 IS NOT NULL THEN 0 WHEN contains(import_path, '/') AND ends_with(file, import_path) THEN 1
            WHEN NOT contains(import_path, '/') AND {_DIR.format("file")} = {_DIR.format("from_file")} THEN 2 WHEN file = from_file THEN 3 ELSE 4 END AS level FROM cand),
        done AS (SELECT edge_id, level::INT AS level, fqn AS out_name, file AS out_file FROM (SELECT *, row_number() OVER (PARTITION BY edge_id
            ORDER BY level, CASE WHEN level = 0 THEN hit0 ELSE 0 END, CASE WHEN level IN (0, 3) THEN false ELSE made END, file, line_start, line_end, fqn) AS r FROM lev) WHERE r = 1
            UNION ALL SELECT edge_id, -1, to_name, '' FROM {edges} WHERE starts_with(to_name, 'taint:'))"""


_R = t.with_tables(t.SYMBOL, t.RAW_EDGE)[:-1] + ", " + _resolve_sql()


def _kept(df: DataFrame) -> DataFrame:
    """A derived table that a query reads several times: an engine would have it stored."""
    return written(df, "derived")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolved(_kept(t.raw_edges(spark, d)), _kept(t.symbols(spark, d)))


@query("resolve_edges", f"{_R} SELECT edge_id, level, out_name, out_file FROM done")
def resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query("resolve_levels", f"{_R} SELECT level, count(*) AS n FROM done GROUP BY level")
def resolve_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


@query("taint_bypass", f"{_R} SELECT edge_id, out_name, out_file FROM done WHERE level = -1")
def taint_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).where("level = -1").select("edge_id", "out_name", "out_file")


@query("unresolved_dropped", f"{_R} SELECT edge_id, to_name FROM raw_edge WHERE edge_id NOT IN (SELECT edge_id FROM done)")
def unresolved_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.raw_edges(spark, sf_dir).join(_resolved(spark, sf_dir), "edge_id", "left_anti").select("edge_id", "to_name")


_FILES = "pf AS (SELECT DISTINCT file FROM symbol WHERE starts_with(file, 'pkg/'))"


@query(
    "import_probe",
    f"""{t.with_tables(t.SYMBOL, t.RAW_EDGE)[:-1]}, {_FILES}, want AS (SELECT DISTINCT edge_id, replace(import_path, '.', '/') AS p FROM raw_edge WHERE import_path IS NOT NULL),
        base AS (SELECT DISTINCT p FROM want), hit AS (SELECT p, file, k FROM base, (VALUES ('.py', 0), ('/__init__.py', 1), ('', 2)) v(e, k) JOIN pf ON ends_with(file, p || e)),
        best AS (SELECT p, arg_min(file, (k, file)) AS file FROM hit GROUP BY p) SELECT edge_id AS import_id, file FROM want JOIN best USING (p)""",
)
def import_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = t.raw_edges(spark, sf_dir).where("import_path is not null").select(F.col("edge_id").alias("import_id"), "import_path", "from_file")
    files = t.symbols(spark, sf_dir).where(F.startswith("file", F.lit("pkg/"))).select("file")
    return resolve.import_files(imports, files).select("import_id", "file")


@query(
    "barrel_chase",
    """WITH f AS (SELECT 'lib/' || source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'S' || doc_id ELSE lower('S' || doc_id) END || CASE WHEN doc_id % 2 = 0 THEN '.ts' ELSE '.jsx' END AS file FROM documents WHERE doc_id % 5 <> 0),
       r AS (SELECT doc_id, 'lib/' || source || '/index.ts' AS barrel, 'S' || doc_id AS s FROM documents)
       SELECT doc_id AS import_id, coalesce((SELECT arg_min(file, k) FROM f, (VALUES ('.ts', 0), ('.tsx', 1), ('.js', 2), ('.jsx', 3)) v(e, k) WHERE file IN ('lib/' || split_part(barrel, '/', 2) || '/' || s || e, 'lib/' || split_part(barrel, '/', 2) || '/' || lower(s) || e)), barrel) AS file FROM r""",
)
def barrel_chase(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    folder, name = F.concat(F.lit("lib/"), "source", F.lit("/")), F.concat(F.lit("S"), "doc_id")
    ending = F.when(F.col("doc_id") % 2 == 0, ".ts").otherwise(".jsx")
    files = docs.where("doc_id % 5 <> 0").select(F.concat(folder, F.when(F.col("doc_id") % 3 == 0, name).otherwise(F.lower(name)), ending).alias("file"))
    found = resolve.chase(docs.select(F.col("doc_id").alias("import_id"), F.concat(folder, F.lit("index.ts")).alias("file"), name.alias("symbol")), files)
    return found.select("import_id", "file")


_REPOS = ["/repo", "/repo/src1", "/repo/src12", "/repo/src1/sub"]


@query("owner_longest_prefix", f"{t.with_tables(t.FILE)} SELECT file, arg_max(r, length(r)) AS owner FROM file, (SELECT unnest([{', '.join(repr(r) for r in _REPOS)}]) AS r) WHERE file = r OR starts_with(file, r || '/') GROUP BY file")
def owner_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.functions.paths import in_repo

    roots = F.array_sort(F.filter(F.lit(_REPOS), lambda r: in_repo(F.col("file"), r)), lambda a, b: F.length(b) - F.length(a))
    return t.files(spark, sf_dir).select("file", F.get(roots, F.lit(0)).alias("owner")).where("owner is not null")


@query("taint_catalog", "SELECT event_id, 'taint:' || CASE WHEN event_type IN ('view', 'click') THEN 'source' ELSE 'sink' END || ':' || event_type AS to_name, 0.95::DOUBLE AS confidence FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def taint_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = spark.createDataFrame([("web", "view", "source", "view"), ("web", "click", "source", "click"), ("web", "purchase", "sink", "purchase")], "lang string, callee string, role string, tag string")
    sites = table(spark, sf_dir, "events").select("event_id", F.lit("web").alias("lang"), F.col("event_type").alias("callee"))
    return resolve.tainted(sites, catalogue).select("event_id", "to_name", "confidence")


_DISK = """disk AS (SELECT file AS path, doc_id * 10 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS mtime, size FROM file WHERE doc_id % 11 <> 0),
    stored AS (SELECT file AS path, doc_id * 10 AS mtime, size, coalesce(quality, 0) AS chunker_version FROM file LEFT JOIN labels USING (doc_id) WHERE doc_id % 13 <> 0)"""


@query(
    "detect_changes",
    f"""{t.with_tables(t.FILE)[:-1]}, {_DISK} SELECT path, kind FROM (SELECT path, CASE WHEN d.mtime IS NULL THEN 'deleted' WHEN s.mtime IS NULL THEN 'added'
        WHEN d.mtime <> s.mtime OR d.size <> s.size OR chunker_version <> 1 THEN 'modified' END AS kind FROM disk d FULL JOIN stored s USING (path)) WHERE kind IS NOT NULL""",
)
def detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = t.files(spark, sf_dir)
    disk = f.where("doc_id % 11 <> 0").select(F.col("file").alias("path"), (F.col("doc_id") * 10 + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("mtime"), "size")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    stored = f.where("doc_id % 13 <> 0").join(marks, "doc_id", "left").select(F.col("file").alias("path"), (F.col("doc_id") * 10).alias("mtime"), "size", F.coalesce("quality", F.lit(0)).alias("chunker_version"))
    return incremental.changes(disk, stored, 1)


#: The surface after an edit: some parts get a name that references asked for in vain, and some are gone.
_AFTER = "after AS (SELECT fqn, CASE WHEN fqn LIKE 'p:%3' THEN 'gone_' || (substr(fqn, 3)::BIGINT * 11) ELSE name END AS name, kind, file, line_start, line_end FROM symbol WHERE fqn NOT LIKE 'p:%77')"


def _after(spark: SparkSession, d: str) -> DataFrame:
    return t.symbols(spark, d).where("fqn NOT LIKE 'p:%77'").withColumn("name", F.when(F.col("fqn").like("p:%3"), F.concat(F.lit("gone_"), F.substring("fqn", 3, 20).try_cast("long") * 11)).otherwise(F.col("name")))


_DELTA = """delta AS (SELECT file, name, fqn, 'removed' AS change FROM symbol s WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.file = s.file AND a.name = s.name AND a.fqn = s.fqn)
    UNION ALL SELECT file, name, fqn, 'added' FROM after a WHERE NOT EXISTS (SELECT 1 FROM symbol s WHERE a.file = s.file AND a.name = s.name AND a.fqn = s.fqn))"""
_D = t.with_tables(t.SYMBOL, t.CALLS, t.RAW_EDGE)[:-1] + f", {_AFTER}, {_DELTA}"
_SETS = """, changed AS (SELECT DISTINCT file FROM delta), d1 AS (SELECT DISTINCT in_file AS file FROM calls WHERE out_file IN (SELECT file FROM changed) AND in_file NOT IN (SELECT file FROM changed)),
    d2 AS (SELECT DISTINCT from_file AS file FROM raw_edge WHERE to_name IN (SELECT name FROM delta WHERE change = 'added')), rs AS (SELECT file FROM changed UNION SELECT file FROM d1 UNION SELECT file FROM d2)"""


def _delta(spark: SparkSession, d: str) -> DataFrame:
    return incremental.surface_delta(t.symbols(spark, d), _after(spark, d))


@query("surface_delta", f"{_D} SELECT * FROM delta")
def surface_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir)


@query("dir1_callers", f"{_D}{_SETS} SELECT file FROM d1")
def dir1_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = _delta(spark, sf_dir).select("file").distinct()
    return incremental.callers_into(t.calls(spark, sf_dir), changed, changed)


@query("dir2_callers", f"{_D}{_SETS} SELECT file FROM d2")
def dir2_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.namers_of(t.raw_edges(spark, sf_dir), _delta(spark, sf_dir).where("change = 'added'"))


def _set(spark: SparkSession, d: str) -> DataFrame:
    delta = _delta(spark, d)
    changed = delta.select("file").distinct()
    return incremental.resolve_set(changed, incremental.callers_into(t.calls(spark, d), changed, changed), incremental.namers_of(t.raw_edges(spark, d), delta.where("change = 'added'")))


@query("resolve_set", f"{_D}{_SETS} SELECT file FROM rs")
def resolve_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set(spark, sf_dir)


@query("incremental_calls", t.with_tables(t.SYMBOL.replace("symbol AS", "symbol0 AS", 1), t.RAW_EDGE)[:-1] + f", {_AFTER.replace('FROM symbol', 'FROM symbol0')}, symbol AS (SELECT * FROM after), {_resolve_sql()} SELECT edge_id, from_file, level, out_name, out_file FROM done JOIN raw_edge USING (edge_id)")
def incremental_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges after an edit, from those before it: equal to resolving all of them against the new symbols.

    All names that the edit touched are in the set here, those that it removed too."""
    before, after, edges = _kept(t.symbols(spark, sf_dir)), _kept(_after(spark, sf_dir)), _kept(t.raw_edges(spark, sf_dir))
    old = resolve.resolved(edges, before, ("from_file",))
    delta = _kept(incremental.surface_delta(before, after))
    changed = delta.select("file").distinct()
    callers = incremental.callers_into(t.calls(spark, sf_dir), changed, changed)
    files = _kept(incremental.resolve_set(changed, callers, incremental.namers_of(edges, delta)))
    return incremental.maintained(old, edges, after, files)


@query(
    "symbol_upsert_last_wins",
    "SELECT fqn, seq, event_type FROM (SELECT 'u:' || user_id AS fqn, event_id AS seq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
)
def symbol_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u:"), "user_id").alias("fqn"), F.col("event_id").alias("seq"), "event_type")
    return incremental.last_wins(rows, ["fqn"], F.col("seq"))


@query("foreign_symbol_merge", "SELECT c_name AS fqn, 'own' AS origin FROM customer UNION ALL SELECT n, 'foreign' FROM (SELECT replace(s_name, 'Supplier', CASE WHEN s_suppkey % 2 = 0 THEN 'Customer' ELSE 'Supplier' END) AS n FROM supplier) WHERE n NOT IN (SELECT c_name FROM customer)")
def foreign_symbol_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_name").alias("fqn"), F.lit("own").alias("origin"))
    name = F.replace(F.col("s_name"), F.lit("Supplier"), F.when(F.col("s_suppkey") % 2 == 0, "Customer").otherwise("Supplier"))
    return incremental.own_first(own, table(spark, sf_dir, "supplier").select(name.alias("fqn"), F.lit("foreign").alias("origin")), "fqn")


@query("embedding_cache_misses", "SELECT DISTINCT md5(text) AS digest, length(text)::BIGINT AS chars FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en')")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cache = docs.where("lang = 'en'").select(F.md5("text").alias("digest"))
    return incremental.cache_misses(docs.select(F.col("text").alias("content")), cache).select("digest", F.length("content").cast("long").alias("chars"))


@query("manifest_widening", """SELECT file FROM (SELECT 'a/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.go' WHEN 1 THEN '.ts' WHEN 2 THEN '.py' ELSE '.rs' END AS file FROM documents) WHERE regexp_matches(file, '\\.(ts|py)$') UNION SELECT unnest(['a/package.json', 'b/pyproject.toml', 'a/0.go'])""")
def manifest_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.lit([".go", ".ts", ".py", ".rs"]), (F.col("doc_id") % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("a/"), "doc_id", ending).alias("file"))
    changed = spark.createDataFrame([("a/package.json",), ("b/pyproject.toml",), ("a/0.go",)], "file string")
    return incremental.widened(changed, files, {"package.json": ("ts", "tsx", "js", "jsx"), "pyproject.toml": ("py",), "go.mod": ("go",)})


@query("nonws_by_repo", r"SELECT source, sum(length(regexp_replace(text, '\s+', '', 'g')))::BIGINT AS chars FROM documents GROUP BY source")
def nonws_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(non_space(F.col("text"))).cast("long").alias("chars"))
