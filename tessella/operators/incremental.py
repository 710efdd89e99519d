"""Change detection, deltas of symbol surfaces, and the maintenance of resolved edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import resolve


def changes(disk: DataFrame, stored: DataFrame, chunker_version: int) -> DataFrame:
    """(path, kind): added, modified or deleted between a listing (path, mtime, size) and what was stored (with chunker_version)."""
    d = disk.select("path", F.col("mtime").alias("mtime_"), F.col("size").alias("size_"), F.lit(True).alias("here_"))
    both = d.join(stored, "path", "full")
    differs = (F.col("mtime") != F.col("mtime_")) | (F.col("size") != F.col("size_")) | (F.col("chunker_version") != chunker_version)
    kind = F.when(F.col("here_").isNull(), "deleted").when(F.col("mtime").isNull(), "added").when(differs, "modified")
    return both.select("path", kind.alias("kind")).where("kind is not null")


def surface_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, name, fqn, change): what symbols' surfaces (file, name, fqn) lost and gained."""
    key = ["file", "name", "fqn"]
    # one join tells both; distinct comes last, as what differs is little and a distinct of all surfaces is held in memory
    both = before.select(*key, F.lit(True).alias("before_")).join(after.select(*key, F.lit(True).alias("after_")), key, "full").where("before_ IS NULL OR after_ IS NULL")
    return both.select(*key, F.when(F.col("after_").isNull(), "removed").otherwise("added").alias("change")).distinct()


def callers_into(calls: DataFrame, changed: DataFrame, affected: DataFrame) -> DataFrame:
    """(file): files outside `affected` that call into changed files. Both sets are (file)."""
    into = calls.join(changed.select(F.col("file").alias("out_file")), "out_file", "left_semi")
    return into.select(F.col("in_file").alias("file")).distinct().join(affected, "file", "left_anti")


def namers_of(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(file): files whose references name one of (name)."""
    return edges.join(names.select(F.col("name").alias("to_name")), "to_name", "left_semi").select(F.col("from_file").alias("file")).distinct()


def resolve_set(changed: DataFrame, callers: DataFrame, namers: DataFrame) -> DataFrame:
    return changed.select("file").unionByName(callers.select("file")).unionByName(namers.select("file")).distinct()


def maintained(resolved: DataFrame, edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """resolved (edge_id, from_file, level, out_name, out_file) with the outgoing edges of `files` resolved anew; equal to resolving all."""
    kept = resolved.join(files.select(F.col("file").alias("from_file")), "from_file", "left_anti")
    again = edges.join(files.select(F.col("file").alias("from_file")), "from_file", "left_semi")
    fresh = resolve.resolved(again, symbols, ("from_file",))
    return kept.unionByName(fresh.select(*kept.columns))


def last_wins(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key by an order that has no ties."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))
    return rows.withColumn("nth_", nth).where("nth_ = 1").drop("nth_")


def own_first(own: DataFrame, foreign: DataFrame, key: str) -> DataFrame:
    """The union by key; where both have it, the own row."""
    return own.unionByName(foreign.join(own.select(key), key, "left_anti"))


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(digest, content): distinct contents, by MD5, of which the cache (digest) has no vector."""
    wanted = texts.select(F.md5("content").alias("digest"), "content").dropDuplicates(["digest"])
    return wanted.join(cache.select("digest"), "digest", "left_anti")


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (file, ..) but for those of deleted files (file)."""
    return rows.join(files.select("file"), "file", "left_anti")


def widened(changed: DataFrame, files: DataFrame, manifests: dict[str, tuple[str, ...]]) -> DataFrame:
    """(file): changed files and, where a manifest changed, all files whose ending its ecosystem has."""
    name = F.substring_index("file", "/", -1)
    ends = F.create_map(*[x for m, e in manifests.items() for x in (F.lit(m), F.array(*map(F.lit, e)))])
    touched = changed.select(F.explode(ends[name]).alias("ending")).distinct()
    every = files.select("file", F.regexp_extract("file", r"\.([^./]+)$", 1).alias("ending")).join(touched, "ending", "left_semi").select("file")
    return changed.select("file").unionByName(every).distinct()


def refreshed(rows: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows (file, ..) of which those of touched files are replaced by fresh ones."""
    return without_files(rows, touched).unionByName(fresh)


def foreign(sidecars: DataFrame, own: str, version: int) -> DataFrame:
    """The symbols of all other repositories' sidecars (repo, version, fqn, ..): those of another version or without an fqn are passed over."""
    return sidecars.where((F.col("repo") != own) & (F.col("version") == version) & F.col("fqn").isNotNull())


def remembered(sessions: DataFrame, most: int = 8192) -> DataFrame:
    """Of sessions (session, used_at, ..) those that were used last, at most so many; of a session its last state.

    The last ones are taken without an order of all: each task keeps as many at most."""
    last = sessions.withColumn("n_", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("used_at")))).where("n_ = 1").drop("n_")
    return last.orderBy(F.desc("used_at"), "session").limit(most)
