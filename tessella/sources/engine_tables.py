"""The engine's tables, derived from the input tables, and the same as DuckDB common table expressions.

`file`, `line` and `chunk` come from documents; `symbol` and `calls` from the foreign keys of the star schema, so that the
graph has hubs, diamonds and ambiguous names; `raw_edge` from line items that name parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import intervals
from tessella.sources.tables import table


def files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    repo = F.concat(F.lit("/repo/"), "source")
    return docs.select(F.concat(repo, F.lit("/"), "doc_id", F.lit("."), "lang").alias("file"), repo.alias("repo"), "doc_id", "lang", F.col("n_chars").alias("size"), "text")


FILE = "file AS (SELECT '/repo/' || source || '/' || doc_id || '.' || lang AS file, '/repo/' || source AS repo, doc_id, lang, n_chars AS size, text FROM documents)"


def lines(files: DataFrame) -> DataFrame:
    """(file, ln, body): ln from 1."""
    return files.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "body")).select("file", (F.col("pos") + 1).alias("ln"), "body")


LINE = "line AS (SELECT file, unnest(generate_series(1, len(b)))::INT AS ln, unnest(b) AS body FROM (SELECT file, string_split(text, chr(10)) AS b FROM file))"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """(file, repo, doc_id, line_start, line_end, content): whole lines of each file, packed to the budget of a chunk."""
    split = files(spark, d).select("file", "repo", "doc_id", F.split("text", "\n").alias("b"))
    packed = split.select("*", F.explode(intervals.packed_lines(F.col("b"))).alias("c"))
    content = F.array_join(F.slice("b", F.col("c.line_start"), F.col("c.line_end") - F.col("c.line_start") + 1), "\n")
    return packed.select("file", "repo", "doc_id", "c.line_start", "c.line_end", content.alias("content"))


#: Needs WITH RECURSIVE, FILE and LINE.
CHUNK = r"""z AS (SELECT file, ln, length(regexp_replace(body, '\s+', '', 'g')) AS n FROM line),
    fold AS (SELECT file, ln, ln AS first, n AS size FROM z WHERE ln = 1
        UNION ALL SELECT z.file, z.ln, CASE WHEN fold.size + z.n > 1500 THEN z.ln ELSE fold.first END, CASE WHEN fold.size + z.n > 1500 THEN z.n ELSE fold.size + z.n END FROM fold JOIN z ON z.file = fold.file AND z.ln = fold.ln + 1),
    packed AS (SELECT file, first::INT AS line_start, max(ln)::INT AS line_end, max(size)::INT AS size FROM fold GROUP BY file, first HAVING max(size) > 0),
    chunk AS (SELECT file, repo, doc_id, line_start, line_end, array_to_string(string_split(text, chr(10))[line_start:line_end], chr(10)) AS content FROM packed JOIN file USING (file))"""


def _span(key: str, width: Column) -> list[Column]:
    start = ((F.col(key) % 1000) * 10 + 1).cast("int")
    return [start.alias("line_start"), (start + width).cast("int").alias("line_end")]


def part_file() -> Column:
    ending = F.when(F.col("p_partkey") % 5 == 0, "_pb2.py").otherwise(".py")
    return F.concat(F.lit("pkg/b"), F.substring("p_brand", 7, 9), F.lit("/m"), (F.col("p_partkey") % 7).cast("string"), ending)


_PART_FILE = "'pkg/b' || substr(p_brand, 7) || '/m' || (p_partkey % 7) || CASE WHEN p_partkey % 5 = 0 THEN '_pb2.py' ELSE '.py' END"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str, mark: str, short: Column, kind: str, file: Column, width: Column) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(mark), key).alias("fqn"), short.alias("name"), F.lit(kind).alias("kind"), file.alias("file"), *_span(key, width))

    at = lambda mark, key: F.concat(F.lit(mark), key)
    five = F.lit(5)
    parts = [
        of("region", "r_regionkey", "r:", F.col("r_name"), "module", F.lit("world"), five),
        of("nation", "n_nationkey", "n:", F.col("n_name"), "class", at("r:", "n_regionkey"), five),
        of("customer", "c_custkey", "c:", F.col("c_name"), "interface", at("n:", "c_nationkey"), five),
        of("supplier", "s_suppkey", "s:", F.col("s_name"), "trait", at("n:", "s_nationkey"), five),
        of("part", "p_partkey", "p:", F.col("p_name"), "function", part_file(), F.col("p_size")),
        of("orders", "o_orderkey", "o:", at("order_", "o_orderkey"), "method", at("c:", "o_custkey"), five),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _symbol(name: str, key: str, mark: str, short: str, kind: str, file: str, width: str = "5") -> str:
    return f"SELECT '{mark}' || {key} AS fqn, {short} AS name, '{kind}' AS kind, {file} AS file, (({key} % 1000) * 10 + 1)::INT AS line_start, (({key} % 1000) * 10 + 1 + {width})::INT AS line_end FROM {name}"


SYMBOL = "symbol AS (" + " UNION ALL ".join([
    _symbol("region", "r_regionkey", "r:", "r_name", "module", "'world'"), _symbol("nation", "n_nationkey", "n:", "n_name", "class", "'r:' || n_regionkey"),
    _symbol("customer", "c_custkey", "c:", "c_name", "interface", "'n:' || c_nationkey"), _symbol("supplier", "s_suppkey", "s:", "s_name", "trait", "'n:' || s_nationkey"),
    _symbol("part", "p_partkey", "p:", "p_name", "function", _PART_FILE, "p_size"), _symbol("orders", "o_orderkey", "o:", "'order_' || o_orderkey", "method", "'c:' || o_custkey"),
]) + ")"


def calls(spark: SparkSession, d: str) -> DataFrame:
    """A row for each call site: (in_name, out_name, in_file, out_file, line, confidence)."""

    def of(rows: DataFrame, a: Column, b: Column, fa: Column, fb: Column, line: Column, confidence: Column) -> DataFrame:
        return rows.select(a.alias("in_name"), b.alias("out_name"), fa.alias("in_file"), fb.alias("out_file"), line.cast("int").alias("line"), confidence.cast("double").alias("confidence"))

    at = lambda mark, key: F.concat(F.lit(mark), key)
    none = F.lit(None)
    nation, customer, supplier, orders = (table(spark, d, t) for t in ("nation", "customer", "supplier", "orders"))
    item = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", part_file().alias("pf")), F.col("l_partkey") == F.col("p_partkey"))
    inferred = F.when(F.col("l_returnflag") == "R", F.round(0.5 + F.col("l_discount"), 2))
    ordered = item.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    supplied = item.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = [
        of(nation, at("r:", "n_regionkey"), at("n:", "n_nationkey"), F.lit("world"), at("r:", "n_regionkey"), F.col("n_nationkey"), none),
        of(customer, at("n:", "c_nationkey"), at("c:", "c_custkey"), F.lit("nations"), at("n:", "c_nationkey"), F.col("c_custkey"), none),
        of(supplier, at("n:", "s_nationkey"), at("s:", "s_suppkey"), F.lit("nations"), at("n:", "s_nationkey"), F.col("s_suppkey"), none),
        of(orders, at("c:", "o_custkey"), at("o:", "o_orderkey"), F.lit("customers"), at("c:", "o_custkey"), F.col("o_orderkey"), none),
        of(ordered, at("o:", "l_orderkey"), at("p:", "l_partkey"), at("c:", "o_custkey"), F.col("pf"), F.col("l_linenumber"), inferred),
        of(supplied, at("s:", "l_suppkey"), at("p:", "l_partkey"), at("n:", "s_nationkey"), F.col("pf"), F.col("l_linenumber"), inferred),
    ]
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


_INFERRED = "CASE WHEN l_returnflag = 'R' THEN round(0.5 + l_discount, 2) END"
CALLS = f"""calls AS (
    SELECT 'r:' || n_regionkey AS in_name, 'n:' || n_nationkey AS out_name, 'world' AS in_file, 'r:' || n_regionkey AS out_file, n_nationkey::INT AS line, NULL::DOUBLE AS confidence FROM nation
    UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'nations', 'n:' || c_nationkey, c_custkey::INT, NULL FROM customer
    UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'nations', 'n:' || s_nationkey, s_suppkey::INT, NULL FROM supplier
    UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'customers', 'c:' || o_custkey, o_orderkey::INT, NULL FROM orders
    UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'c:' || o_custkey, {_PART_FILE}, l_linenumber, {_INFERRED} FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey, 'n:' || s_nationkey, {_PART_FILE}, l_linenumber, {_INFERRED} FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """References by leaf name: every thirteenth is tainted, every eleventh names nothing, and every third has an import path."""
    part = table(spark, d, "part").select("p_partkey", "p_name", F.substring("p_brand", 7, 9).alias("b"))
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    name = F.when(k % 13 == 0, F.lit("taint:source:env")).when(k % 11 == 0, F.concat(F.lit("gone_"), k.cast("string"))).otherwise(F.col("p_name"))
    path = F.when(k % 9 == 0, F.concat(F.lit("b"), "b", F.lit("/m"), (k % 7).cast("string"), F.lit(".py"))).when(k % 9 == 3, "helper").when(k % 9 == 6, F.concat(F.lit("pkg.b"), "b", F.lit(".m"), (k % 7).cast("string")))
    return (
        table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("edge_id"), F.concat(F.lit("pkg/b"), (F.col("l_suppkey") % 25 + 1).cast("string"), F.lit("/m"), (k % 7).cast("string"), F.lit(".py")).alias("from_file"),
                F.concat(F.lit("o:"), "l_orderkey").alias("from_fqn"), name.alias("to_name"), path.alias("import_path"), F.col("l_linenumber").alias("line"),
                F.when(F.col("l_returnflag") == "R", F.round(0.5 + F.col("l_discount"), 2)).alias("confidence"))
    )


RAW_EDGE = f"""raw_edge AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT AS edge_id, 'pkg/b' || (l_suppkey % 25 + 1) || '/m' || (k % 7) || '.py' AS from_file, 'o:' || l_orderkey AS from_fqn,
    CASE WHEN k % 13 = 0 THEN 'taint:source:env' WHEN k % 11 = 0 THEN 'gone_' || k ELSE p_name END AS to_name,
    CASE WHEN k % 9 = 0 THEN 'b' || substr(p_brand, 7) || '/m' || (k % 7) || '.py' WHEN k % 9 = 3 THEN 'helper' WHEN k % 9 = 6 THEN 'pkg.b' || substr(p_brand, 7) || '.m' || (k % 7) END AS import_path,
    l_linenumber AS line, {_INFERRED} AS confidence FROM (SELECT *, l_orderkey * 8 + l_linenumber AS k FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def with_tables(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
