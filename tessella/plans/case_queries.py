"""Queries whose cases, and what they come down to, are written out by hand: each row of a table takes one, by its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import paths
from tessella.operators import filters, graph, resolve
from tessella.plans import extract_queries as x
from tessella.plans import graph_queries as g
from tessella.plans.registry import query
from tessella.sources import engine_tables as t
from tessella.sources.tables import table


def _values(*rows: tuple) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in (k, *row)) + ")" for k, row in enumerate(rows))


def _at(key: Column, values: list[str]) -> Column:
    return F.element_at(F.lit(values), (key % len(values) + 1).cast("int"))


#: Imports of each language: (importing file, path, file that it comes down to).
_IMPORTS = (
    ("web/src/a.ts", "./b", "web/src/b.ts"), ("web/src/a.ts", "../lib/c", "web/lib/c.tsx"), ("web/src/a.ts", "./dir", "web/src/dir/index.js"), ("web/src/a.js", "src/b", "web/src/b.ts"), ("web/src/a.tsx", "./none", None),
    ("py/pkg/m.py", ".n", "py/pkg/n.py"), ("py/pkg/m.py", "..top", "py/top.py"), ("py/pkg/m.py", "pkg.sub", "py/pkg/sub/__init__.py"), ("py/pkg/m.py", "./n.py", "py/pkg/n.py"),
    ("rs/src/main.rs", "crate::config", "rs/src/config.rs"), ("rs/src/main.rs", "crate::net", "rs/src/net/mod.rs"), ("rs/src/net/mod.rs", "self::tcp", "rs/src/net/tcp.rs"), ("c/a.c", "b.h", None),
)
_PLACES = ("web/src/b.ts", "web/lib/c.tsx", "web/src/dir/index.js", "py/pkg/n.py", "py/top.py", "py/pkg/sub/__init__.py", "rs/src/config.rs", "rs/src/net/mod.rs", "rs/src/net/tcp.rs", "web/src/bb.ts")


@query("import_languages", f"SELECT doc_id AS import_id, f AS file FROM documents JOIN (VALUES {_values(*[(f,) for *_, f in _IMPORTS])}) v(k, f) ON doc_id % {len(_IMPORTS)} = k WHERE f IS NOT NULL")
def import_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative, absolute and dotted imports of TypeScript, JavaScript, Python and Rust."""
    key = F.col("doc_id")
    imports = table(spark, sf_dir, "documents").select(key.alias("import_id"), _at(key, [p for _, p, _ in _IMPORTS]).alias("import_path"), _at(key, [f for f, _, _ in _IMPORTS]).alias("from_file"))
    return resolve.import_files(imports, spark.createDataFrame([(p,) for p in _PLACES], "file string")).select("import_id", "file")


#: Files that hand on what their neighbours define: (file, symbol, file that it is found in).
_BARRELS = (
    ("a/index.ts", "Card", "a/Card.tsx"), ("a/index.js", "Tool", "a/tool.js"), ("b/__init__.py", "Model", "b/model.py"), ("c/mod.rs", "Reader", "c/reader.rs"), ("d/index.ts", "Page", "d/Page/Page.ts"), ("b/__init__.py", "Gone", "b/__init__.py"), ("a/plain.ts", "Card", "a/plain.ts"),
)
_NEIGHBOURS = ("a/Card.tsx", "a/Card.js", "a/tool.js", "b/model.py", "b/model.rs", "c/reader.rs", "d/Page/index.ts", "d/Page/Page.ts")


@query("barrel_languages", f"SELECT doc_id AS import_id, f AS file FROM documents JOIN (VALUES {_values(*[(f,) for *_, f in _BARRELS])}) v(k, f) ON doc_id % {len(_BARRELS)} = k")
def barrel_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    found = table(spark, sf_dir, "documents").select(key.alias("import_id"), _at(key, [f for f, *_ in _BARRELS]).alias("file"), _at(key, [s for _, s, _ in _BARRELS]).alias("symbol"))
    return resolve.chase(found, spark.createDataFrame([(p,) for p in _NEIGHBOURS], "file string")).select("import_id", "file")


#: An ending of each language.
_LANGUAGES = (
    ("a.c", "c"), ("a.hpp", "cpp"), ("a.cs", "csharp"), ("a.dart", "dart"), ("a.go", "go"), ("a.java", "java"), ("a.mjs", "javascript"), ("a.kts", "kotlin"), ("a.liquid", "liquid"), ("a.lua", "lua"), ("a.luau", "luau"), ("a.m", "objectivec"),
    ("a.pas", "pascal"), ("a.php", "php"), ("a.proto", "proto"), ("a.py", "python"), ("a.rb", "ruby"), ("a.rs", "rust"), ("a.svelte", "svelte"), ("a.swift", "swift"), ("a.tsx", "tsx"), ("a.ts", "typescript"), ("a.vue", "vue"), ("a.txt", "other"),
    (".py", "other"), ("py", "other"), ("a.b.py", "python"), ("x/.d/a.rs", "rust"),
)


@query("languages_detected", f"SELECT source || '/' || p AS file, lang AS language FROM (SELECT DISTINCT source FROM documents), (VALUES {_values(*_LANGUAGES)}) v(k, p, lang)")
def languages_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("source").distinct().select("source", F.explode(F.lit([p for p, _ in _LANGUAGES])).alias("p")).select(F.concat_ws("/", "source", "p").alias("file"))
    return made.select("file", paths.language(F.col("file")).alias("language"))


@query("filter_alias", f"SELECT replace(f, '{{k}}', p_partkey::VARCHAR) AS file FROM part JOIN (VALUES {_values(*[(s[0],) for s in x._SOURCES])}) v(k, f) ON p_partkey % {x.N} = k WHERE f LIKE '%.py' OR f LIKE '%.rs' OR f LIKE '%.rb'")
def filter_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by their short names."""
    files = x.sources(spark, sf_dir).select("file", paths.language(F.col("file")).alias("lang"))
    return files.where(filters.parse("lang:py language:RS lang:rb")[1].condition(lang="lang")).select("file")


@query("filter_kind_none", f"{t.with_tables(t.SYMBOL)} SELECT fqn FROM symbol WHERE fqn LIKE '%9' OR contains(kind, 'class')")
def filter_kind_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol whose kind isn't known passes."""
    some = t.symbols(spark, sf_dir).withColumn("kind", F.when(~F.col("fqn").like("%9"), F.col("kind")))
    return some.where(filters.parse("kind:class")[1].condition(kind="kind")).select("fqn")


@query(
    "impact_listing",
    g.levels("SELECT 'p:1' AS seed", 3) + ", n AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY fqn) AS r, count(*) OVER (PARTITION BY depth) AS c FROM lv) SELECT depth, string_agg(fqn, ', ' ORDER BY r) FILTER (r <= 40) || CASE WHEN any_value(c) > 40 THEN ' +' || (any_value(c) - 40) || ' more' ELSE '' END AS names FROM n GROUP BY depth",
)
def impact_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reaches a part, by its distance: forty names each, and how many more there are."""
    found = graph.impact(t.calls(spark, sf_dir), spark.createDataFrame([("p:1",)], "seed string"))
    return graph.listed(found, "depth", "fqn", 40)


@query("first_of_names", f"{t.with_tables(t.SYMBOL)} SELECT name, fqn, r::INT AS place FROM (SELECT name, fqn, row_number() OVER (PARTITION BY name ORDER BY fqn) AS r FROM symbol) WHERE r <= 10")
def first_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols that a bare name may mean: ten are shown."""
    nth = F.row_number().over(Window.partitionBy("name").orderBy("fqn"))
    return t.symbols(spark, sf_dir).select("name", "fqn", nth.alias("place")).where("place <= 10")
