"""Lexical search, fusion, filters and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import paths, text
from tessella.operators import filters, lexical, vector
from tessella.plans.registry import query
from tessella.sources import engine_tables as t
from tessella.sources.tables import table

#: What the lexical queries look for: its terms, most specific first.
SOUGHT = "whereIs tionNess keitThand licenseToken"
TERMS = ["license", "thand", "token", "keit", "ness", "tion"]
LIMIT = lexical.pool_limit(10)
_LIST = "[" + ", ".join(f"'{x}'" for x in TERMS) + "]"
_POOL = f"""pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY file, line_start, line_end)::INT AS nth FROM chunk, (SELECT unnest({_LIST}) AS term)
    WHERE contains(lower(content), term) OR contains(lower(file), term)) WHERE nth <= {LIMIT})"""
_DF = "df AS (SELECT term, count(*) AS df FROM pool GROUP BY term), mx AS (SELECT max(df) AS m FROM df)"
_TOK = r"regexp_split_to_array(body, '[^\p{L}\p{N}_]+')"
_SCORED = rf"""rows AS (SELECT DISTINCT file, line_start, line_end, content, symbol, lower(content) || chr(10) || coalesce(lower(symbol), '') AS body, lower(file) AS path FROM pool),
    w AS (SELECT r.file, r.line_start, sum(CASE WHEN contains(body, term) THEN x ELSE x * 0.5 END) AS s FROM rows r,
        (SELECT term, 1.0 - 0.5 * ln(1.0 + coalesce(df, 1)) / greatest(ln(1.0 + m), 1.0) AS x FROM (SELECT unnest({_LIST}) AS term) LEFT JOIN df USING (term), mx) WHERE contains(body, term) OR contains(path, term) GROUP BY ALL),
    run AS (SELECT file, line_start, list_max(list_transform({_TOK}, lambda k: list_sum(list_transform({_LIST}, lambda t: CASE WHEN contains(k, t) THEN 1 ELSE 0 END)))) AS n,
        list_bool_or(list_transform({_TOK}, lambda k: regexp_replace(k, '[^\p{{L}}\p{{N}}]', '', 'g') = '{"".join(TERMS)}'))
            OR coalesce(regexp_replace(lower(regexp_extract(symbol, '[^:]*$')), '[^\p{{L}}\p{{N}}]', '', 'g') = '{"".join(TERMS)}', false) AS witness FROM rows),
    scored AS (SELECT r.*, witness, 0.55 * least(s / {len(TERMS)} + CASE WHEN n >= 2 THEN 2.0 * (n / {len(TERMS)}.0) * (n / {len(TERMS)}.0) ELSE 0 END, 1.0) + CASE WHEN witness THEN 0.25 ELSE 0 END AS score
        FROM rows r JOIN w USING (file, line_start) JOIN run USING (file, line_start))"""
#: A chunk of every seventh document lies in a symbol, and of every twenty-eighth in one that is named as what is sought.
_HELD = "'pkg::' || CASE WHEN doc_id % 28 = 0 THEN 'License_Thand_' || 'TokenKeitNessTion' WHEN doc_id % 7 = 0 THEN 'tokenOf' END"
_LEX = f"WITH RECURSIVE {t.FILE}, {t.LINE}, {t.CHUNK.replace('chunk AS (', 'chunk0 AS (')}, chunk AS (SELECT *, {_HELD} AS symbol FROM chunk0), {_POOL}"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id")
    name = F.when(key % 28 == 0, "License_Thand_TokenKeitNessTion").when(key % 7 == 0, "tokenOf")
    return t.chunks(spark, d).withColumn("symbol", F.concat(F.lit("pkg::"), name))


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    return lexical.pools(_chunks(spark, d), TERMS, LIMIT)


@query("tokenize_terms", f"SELECT pos::INT AS pos, term FROM (SELECT unnest({_LIST}) AS term, unnest(range({len(TERMS)})) AS pos)")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(text.terms(F.lit(SOUGHT))).alias("pos", "term"))


@query("lexical_pools", f"{_LEX} SELECT term, file, line_start, line_end, nth FROM pool")
def lexical_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir).select("term", "file", "line_start", "line_end", "nth")


@query("lexical_df", f"{_LEX}, {_DF} SELECT term, df, m AS max_df FROM df, mx")
def lexical_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.frequencies(_pooled(spark, sf_dir))
    return found.select("term", "df", F.max("df").over(Window.partitionBy(F.lit(0))).alias("max_df"))


@query("lexical_score", f"{_LEX}, {_DF}, {_SCORED} SELECT file, line_start, round(score, 6) AS score FROM scored WHERE length(trim(content)) >= 1 ORDER BY round(score, 9) DESC, length(content), file, line_start LIMIT {LIMIT}")
def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(lexical.scored(_pooled(spark, sf_dir), TERMS), LIMIT).select("file", "line_start", F.round("score", 6).alias("score"))


@query("lexical_witness", f"{_LEX}, {_DF}, {_SCORED} SELECT witness, count(*) AS n, round(max(score), 6) AS best FROM scored GROUP BY witness")
def lexical_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.scored(_pooled(spark, sf_dir), TERMS).groupBy("witness").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


#: An embedding is that of its document's first chunk; what is sought has the vector of document 7.
_VECTOR = """firsts AS (SELECT file, doc_id, min(line_start) AS line_start, arg_min(line_end, line_start) AS line_end FROM chunk GROUP BY file, doc_id),
    near AS (SELECT file, line_start, line_end, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings e JOIN firsts ON doc_id = vec_id),
    vx AS (SELECT *, row_number() OVER (ORDER BY score DESC, file)::INT AS vrank FROM near QUALIFY vrank <= 20)"""
LISTS = f"""{_LEX}, {_DF}, {_SCORED},
    lx AS (SELECT file, line_start, line_end, score, row_number() OVER (ORDER BY round(score, 9) DESC, length(content), file, line_start)::INT AS lrank FROM scored WHERE length(trim(content)) >= 1 QUALIFY lrank <= 20), {_VECTOR},
    fused AS (SELECT file, line_start, line_end, vrank, lrank, coalesce(1.0 / (60 + vrank), 0) + coalesce(0.7 / (60 + lrank), 0) AS rrf, coalesce(vx.score, lx.score) AS score FROM vx FULL JOIN lx USING (file, line_start, line_end))"""


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    """The twenty chunks whose vectors are nearest, with their scores."""
    firsts = t.chunks(spark, d).groupBy("file", "doc_id").agg(F.min(F.struct("line_start", "line_end")).alias("c")).select("file", "doc_id", "c.line_start", "c.line_end")
    vectors = table(spark, d, "embeddings")
    placed = firsts.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").drop("doc_id")
    return vector.topk(placed, vectors.where("vec_id = 7"), "file", 20)


def fused(spark: SparkSession, d: str) -> DataFrame:
    """The vectors' twenty and the words' twenty, fused."""
    vector_list, lexical_list = _nearest(spark, d), lexical.ranked(lexical.scored(_pooled(spark, d), TERMS), 20)
    # each list has 20 rows
    one = Window.partitionBy(F.lit(0))
    v = vector_list.withColumn("rank", F.row_number().over(one.orderBy(F.desc("score"), "file")))
    w = lexical_list.withColumn("rank", F.row_number().over(one.orderBy(F.desc(F.round("score", 9)), F.length("content"), *lexical.KEY)))
    return lexical.rrf(v, w)


@query("rrf_fusion", f"{LISTS} SELECT file, line_start, line_end, vrank, lrank, round(rrf, 6) AS rrf, round(score, 6) AS score FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).withColumns({"rrf": F.round("rrf", 6), "score": F.round("score", 6)})


@query("hybrid_truncate", f"{LISTS} SELECT file, line_start, round(rrf, 6) AS rrf FROM fused ORDER BY round(rrf, 9) DESC, vrank NULLS LAST, lrank NULLS LAST, file LIMIT 20")
def hybrid_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).orderBy(*lexical.fused_order()).limit(20).select("file", "line_start", F.round("rrf", 6).alias("rrf"))


@query("identifier_split", r"SELECT s_suppkey, trim(regexp_replace(lower(regexp_replace(regexp_replace(s_name || '_fooBar2Baz', '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g'), '[_.\-]+', ' ', 'g')), ' +', ' ', 'g')) AS words FROM supplier")
def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.identifier_words(F.concat("s_name", F.lit("_fooBar2Baz"))).alias("words"))


@query("token_estimate", "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


#: The rules of redaction as one may write them in SQL: (expression, what is left), in order.
_REDACT = (
    ("-----BEGIN ([A-Z ]*)PRIVATE KEY-----[^-]+-----END [A-Z ]*PRIVATE KEY-----", "<redacted private key>"),
    (r"\b(AKIA|ASIA)[A-Z0-9]{16,}", "<redacted aws>"),
    (r"\bgh[opusr]_[A-Za-z0-9]{36,}", "<redacted github>"),
    (r"\bgithub_pat_\w{40,}", "<redacted github>"),
    (r"\bglpat-[\w-]{20,}", "<redacted gitlab>"),
    (r"\bAIza[\w-]{35,}", "<redacted google>"),
    (r"\bhf_[A-Za-z0-9]{30,}", "<redacted huggingface>"),
    (r"\bsk-[\w-]{24,}", "<redacted model-api>"),
    (r"\bnpm_[A-Za-z0-9]{36,}", "<redacted npm>"),
    (r"\bpypi-[\w-]{50,}", "<redacted pypi>"),
    (r"\bSG\.[\w.-]{60,}", "<redacted sendgrid>"),
    (r"\bxox[abprs]-[A-Za-z0-9-]{12,}", "<redacted slack>"),
    (r"\b[sr]k_(live|test)_[A-Za-z0-9]{16,}", "<redacted stripe>"),
    (r"\beyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]+", "<redacted jwt>"),
    (r"\b([Bb]earer|[Bb]asic) +[\w+/=.~-]{16,}", r"\1 <redacted header>"),
    (r"(://[^\s/:@]+):[^\s/:@]+@", r"\1:<redacted password>@"),
    (r"""(?i)(passphrase|secret_key|access_key|password|api_key|passwd|secret|apikey|token)(["']? *[:=] *["']?)[\w+/.=-]{8,}""", r"\1\2<redacted value>"),
)


def redact_sql(column: str) -> str:
    for pattern, left in _REDACT:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{left}', 'g')"
    return column


@query("redact_secrets", f"SELECT doc_id, md5({redact_sql('text')}) AS redacted, text <> {redact_sql('text')} AS changed FROM documents")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", text.redacted(F.col("text")).alias("r"))
    return docs.select("doc_id", F.md5("r").alias("redacted"), (F.col("r") != F.col("text")).alias("changed"))


@query("secret_counts", f"SELECT source, sum(len(string_split(r, '<redacted ')) - 1)::BIGINT AS secrets FROM (SELECT source, {redact_sql('text')} AS r FROM documents) GROUP BY source")
def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.regexp_count(text.redacted(F.col("text")), F.lit("<redacted "))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(marks).cast("long").alias("secrets"))


@query("content_fence", "SELECT source, count(*) FILTER (length(trim(text)) >= 1) AS kept, count(*) FILTER (length(trim(text)) < 1) AS dropped FROM documents GROUP BY source")
def content_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.length(F.trim("text")) < 1
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(~blank).alias("kept"), F.count_if(blank).alias("dropped"))


_F = t.with_tables(t.FILE)


@query("filter_path", f"{_F} SELECT file FROM file WHERE contains(file, '/src7/') OR contains(file, '9.de')")
def filter_path(spark: SparkSession, sf_dir: str) -> DataFrame:

    return t.files(spark, sf_dir).where(filters.parse("path:/src7/ path:9.de")[1].condition(path="file")).select("file")


@query("filter_lang", f"{_F} SELECT file, lang FROM file WHERE lang IN ('de', 'fr')")
def filter_lang(spark: SparkSession, sf_dir: str) -> DataFrame:

    return t.files(spark, sf_dir).where(filters.parse("lang:de LANGUAGE:fr")[1].condition(lang="lang")).select("file", "lang")


_S = t.with_tables(t.SYMBOL)


@query("filter_kind", f"{_S} SELECT fqn, kind FROM symbol WHERE contains(kind, 'trait') OR contains(kind, 'class')")
def filter_kind(spark: SparkSession, sf_dir: str) -> DataFrame:

    return t.symbols(spark, sf_dir).where(filters.parse("kind:Trait kind:class")[1].condition(kind="kind")).select("fqn", "kind")


@query("filter_name_exact", f"{_S} SELECT fqn, name FROM symbol WHERE contains(lower(name), 'ring')")
def filter_name_exact(spark: SparkSession, sf_dir: str) -> DataFrame:

    return filters.by_name(t.symbols(spark, sf_dir), ["ring"], "name").select("fqn", "name")


@query("filter_name_fuzzy", f"{_S} SELECT fqn, name FROM symbol WHERE levenshtein(lower(name), 'natiom_1') <= 2")
def filter_name_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No name holds the text, so names within two edits are taken."""

    return filters.by_name(t.symbols(spark, sf_dir), ["natiom_1"], "name").select("fqn", "name")


@query("edit_distance", "SELECT p_partkey, least(levenshtein(lower(p_name), 'small ring'), 3)::INT AS distance FROM part")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:

    return table(spark, sf_dir, "part").select("p_partkey", filters.bounded_distance(F.col("p_name"), F.lit("small ring"), 2).alias("distance"))


@query("repo_scope", f"{_F} SELECT file FROM file WHERE file = '/repo/src1' OR starts_with(file, '/repo/src1/')")
def repo_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/repo/src1 holds no file of /repo/src10."""
    return t.files(spark, sf_dir).where(paths.in_repo(F.col("file"), F.lit("/repo/src1"))).select("file")


@query("file_browser_page", f"{_F} SELECT file, size FROM file WHERE contains(lower(file), 'src1') ORDER BY file LIMIT 50")
def file_browser_page(spark: SparkSession, sf_dir: str) -> DataFrame:

    return filters.page(t.files(spark, sf_dir), "file", 50, part="SRC1").select("file", "size")


@query("keyset_page", f"{_F} SELECT file FROM file WHERE contains(lower(file), 'src1') AND file > '/repo/src12/5' ORDER BY file LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:

    return filters.page(t.files(spark, sf_dir), "file", 50, part="src1", after="/repo/src12/5").select("file")


@query("language_detect", f"{_F} SELECT substr(file, 1, length(file) - 2) || e AS path, l AS language FROM file, (VALUES ('py', 'python'), ('h', 'cpp'), ('mm', 'objectivec'), ('xyz', 'other'), ('tsx', 'tsx')) v(e, l)")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.explode(F.lit(["py", "h", "mm", "xyz", "tsx"]))
    renamed = t.files(spark, sf_dir).select("file", ends.alias("e")).select(F.expr("concat(substr(file, 1, length(file) - 2), e)").alias("path"))
    return renamed.select("path", paths.language(F.col("path")).alias("language"))


_CASES = ["/x.py", "/.git/x.py", "/.eslintrc.json", "/node_modules/a/b.js", "/Dockerfile", "/a.PY", "/bin.exe", "/vendor/z.go", "/a/build/c.c", "/Makefile", "/notes", "/b.mjs", "/b.zig"]
_CASE_SQL = "(SELECT unnest([" + ", ".join(f"'{c}'" for c in _CASES) + "]) AS c)"


@query(
    "indexable_paths",
    rf"""{_F} SELECT path, e IN ('py', 'json', 'js', 'go', 'c', 'zig') OR (e = '' AND lower(n) IN ('dockerfile', 'justfile', 'makefile')) AS indexable,
        regexp_matches(path, '(^|/)\.[^/]*/') AS hidden, regexp_matches(path, '(^|/)(__pycache__|build|dist|node_modules|target|vendor)/') AS skipped
        FROM (SELECT path, n, lower(regexp_extract(n, '^.+\.([^.]*)$', 1)) AS e FROM (SELECT file || c AS path, regexp_extract(c, '[^/]*$') AS n FROM file, {_CASE_SQL}))""",
)
def indexable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = t.files(spark, sf_dir).select("file", F.explode(F.lit(_CASES)).alias("c")).select(F.concat("file", "c").alias("path"))
    p = F.col("path")
    return made.select("path", paths.is_indexable(p).alias("indexable"), paths.is_hidden(p).alias("hidden"), paths.is_skipped(p).alias("skipped"))


#: A path for each rule of generated files, and some that no rule has: (end of the path, generated).
_WRITTEN = (
    ("/a_pb2.py", True), ("/a_pb2_grpc.py", True), ("/a.py", False), ("/pb2.py", False), ("/x.pb.go", True), ("/x.pb.gw.go", True), ("/pb.go", False), ("/n.pb.cc", True), ("/n.pb.h", True), ("/q_pb.js", True),
    ("/t_generated.rs", True), ("/generated.rs", False), ("/kind_string.go", True), ("/mock_store.go", True), ("/mock_store.py", False), ("/zz_generated.deepcopy.go", True), ("/ent/u.go", True), ("/ent/u.md", False),
    ("/m.g.dart", True), ("/m.freezed.dart", True), ("/m.mocks.dart", True), ("/m.dart", False), ("/Form.Designer.cs", True), ("/r.g.i.cs", True), ("/r.generated.cs", True), ("/h.generated.tsx", True), ("/s.generated.swift", True),
    ("/moc_win.cpp", True), ("/ui_main.h", True), ("/main.h", False), ("/qrc_icons.cpp", True), ("/p.tab.c", True), ("/p.tab.hh", True), ("/lex.yy.c", True), ("/lex.c", False), ("/__generated__/q.graphql.js", True),
    ("/.next/a.js", True), ("/.nuxt/a.js", True), ("/generated-sources/A.java", True), ("/dist/app.js", True), ("/dist/sub/app.mjs", True), ("/dist/notes.md", False), ("/generated/q.ts", True), ("|node_modules|z.js", True),
    ("/vendor/q.rs", True), ("/vendored/q.rs", False), ("/__pycache__/a.pyc", True), ("/src/u.go", False),
)
_WRITTEN_SQL = ", ".join(f"('{w}', {m})" for w, m in _WRITTEN)


@query("generated_paths", f"{_F} SELECT file || replace(c, '|', chr(92)) AS path, m AS is_generated FROM file, (VALUES {_WRITTEN_SQL}) v(c, m)")
def generated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.explode(F.lit([w.replace("|", "\\") for w, _ in _WRITTEN]))
    rows = t.files(spark, sf_dir).select("file", ends.alias("c")).select(F.concat("file", "c").alias("path"))
    return rows.select("path", paths.is_generated(F.col("path")).alias("is_generated"))
