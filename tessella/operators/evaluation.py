"""How good chunks and rankings are, and how candidates become an answer of bounded size."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import intervals

LEGACY_LINES, LEGACY_STEP = 50, 25


def width() -> Column:
    return F.col("line_end") - F.col("line_start") + 1


def quality(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row on chunks (file, line_start, line_end) against symbols (fqn, file, ..): chunks, lines, the largest, lines per
    covered line, neighbours that overlap, symbols per chunk (0, 1, 2, more), and symbols that a chunk's edge cuts through."""
    order = Window.partitionBy("file").orderBy("line_start", "line_end")
    sizes = chunks.withColumn("laps_", (F.lag("line_end").over(order) >= F.col("line_start")).cast("int")).agg(
        F.count("*").alias("chunks"), F.sum(width()).alias("lines"), F.max(width()).alias("largest"), F.coalesce(F.sum("laps_"), F.lit(0)).alias("laps")
    )
    covered = intervals.islands(chunks, 0).agg(F.sum(width()).alias("covered"))
    pairs = intervals.overlapping(chunks, symbols)
    inside = (F.col("r_line_start") >= F.col("line_start")) & (F.col("r_line_end") <= F.col("line_end"))
    per_chunk = pairs.groupBy("file", "line_start", "line_end").agg(F.count("*").alias("n"))
    held = per_chunk.agg(*[F.count(F.when(F.col("n") == n, 1)).alias(f"with_{n}") for n in (1, 2)], F.count(F.when(F.col("n") > 2, 1)).alias("with_more"))
    cut = pairs.groupBy("r_fqn").agg(F.max(inside.cast("int")).alias("whole")).agg(F.count(F.when(F.col("whole") == 0, 1)).alias("cut"), F.count("*").alias("met"))
    # four tables of one row
    row = sizes.join(F.broadcast(covered)).join(F.broadcast(held)).join(F.broadcast(cut))
    return row.select("chunks", "lines", "largest", "laps", (F.col("lines") / F.col("covered")).alias("duplication"), (F.col("chunks") - F.col("with_1") - F.col("with_2") - F.col("with_more")).alias("with_0"), "with_1", "with_2", "with_more", (F.col("cut") / F.col("met")).alias("cut_rate"))


def retrieval(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """One row on rankings (query, rank, file, line_start, line_end), rank from 1, against gold ranges (query, file,
    line_start, line_end): recall at 1, 5 and 10, and the mean over queries of the best overlap among ten."""
    g = gold.select("query", *[F.col(c).alias(f"g_{c}") for c in ("file", "line_start", "line_end")])
    met = F.least("line_end", "g_line_end") - F.greatest("line_start", "g_line_start") + 1
    both = F.greatest("line_end", "g_line_end") - F.least("line_start", "g_line_start") + 1
    hit = (F.col("file") == F.col("g_file")) & (met > 0)
    best = g.join(ranked, "query", "left").groupBy("query").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.max(F.when(hit & (F.col("rank") <= 10), met / both)).alias("iou"))
    at = [F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in (1, 5, 10)]
    return best.agg(F.count("*").alias("queries"), *at, F.avg(F.coalesce("iou", F.lit(0.0))).alias("mean_iou"))


def word_recall(queries: DataFrame, documents: DataFrame, least: int = 6, head: int = 60) -> DataFrame:
    """One row: recall at 1, 5 and 10 of documents (doc_id, text) ranked by the words they share with queries (item_id, text).

    A stated query set, of 65,536 at most, meets all documents by their words; right is each document that holds the query's
    first characters."""
    if queries.limit((1 << 16) + 1).count() > 1 << 16:
        raise ValueError("more queries than are sent to all tasks")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= least))
    asked = queries.select("item_id", F.explode(words("text")).alias("w"))
    shared = documents.select("doc_id", F.explode(words("text")).alias("w")).join(asked, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "doc_id"))
    ranked = shared.withColumn("rank", rank)
    begins = queries.select("item_id", F.lower(F.substring(F.trim("text"), 1, head)).alias("head"))
    gold = documents.select("doc_id", F.lower("text").alias("t")).join(F.broadcast(begins), F.contains("t", F.col("head"))).select("item_id", "doc_id")
    best = gold.join(ranked, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias("first"))
    at = [F.round(F.coalesce(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")), F.lit(0.0)), 6).alias(f"recall_{k}") for k in (1, 5, 10)]
    return best.agg(F.count("*").alias("queries"), *at)


def deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: each number of report b less that of report a. Both are one row."""
    return a.select(F.struct("*").alias("a")).join(F.broadcast(b.select(F.struct("*").alias("b")))).select(*[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(c) for c in a.columns])


def legacy_windows(files: DataFrame, symbols: DataFrame, lines: int = LEGACY_LINES, step: int = LEGACY_STEP) -> DataFrame:
    """(file, line_start, line_end): each symbol's lines, and sliding windows over runs of lines of files (file, n_lines) that no
    symbol covers; a run's last window ends with it."""
    own = symbols.join(files, "file").where("line_start <= n_lines").select("file", "line_start", F.least("line_end", "n_lines").alias("line_end"))
    edges = files.where("n_lines > 0").select("file", F.explode(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")), F.struct((F.col("n_lines") + 1).alias("a"), (F.col("n_lines") + 1).alias("b")))).alias("e"))
    every = intervals.islands(own, 1).unionByName(edges.select("file", F.col("e.a").alias("line_start"), F.col("e.b").alias("line_end")))
    last = F.lag("line_end").over(Window.partitionBy("file").orderBy("line_start", "line_end"))
    gaps = every.withColumn("a_", last + 1).withColumn("b_", F.col("line_start") - 1).where("a_ <= b_")
    starts = F.sequence(F.col("a_"), F.greatest(F.col("a_"), F.col("b_") - (lines - step)), F.lit(step))
    windows = gaps.select("file", "b_", F.explode(starts).alias("s")).select("file", F.col("s").cast("int").alias("line_start"), F.least(F.col("s") + (lines - 1), F.col("b_")).cast("int").alias("line_end"))
    return own.select("file", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end")).unionByName(windows)


def nearest_rank(rows: DataFrame, keys: list[str], value: str, parts: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Per key the least value that at least such a part of the values don't exceed, as p50, p95, .."""
    return rows.groupBy(*keys).agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * p)}") for p in parts])


def within_budget(blocks: DataFrame, by: str, order: str, size: Column, budget: int) -> DataFrame:
    """blocks with `whole`: in order, which no two blocks of a group share, blocks are whole while they fit together; after the
    first that doesn't, none is. Only the sizes are put in order, so no task holds a group's texts."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.select(by, order, size.alias("size_")).select(by, order, (F.sum("size_").over(so_far) <= budget).alias("whole"))
    return blocks.join(placed, [by, order])


#: Lines around a range that a reply selects, and lines of a chunk that is never cut to ranges.
RANGE_PAD, LEAST_PRUNED = 2, 16
_TAGGED = re.compile(r"<ranked_indices>(.*?)</ranked_indices>", re.S)


def selections(reply: str) -> list[tuple[int, list[tuple[int, int]]]] | None:
    """What a reranker's reply names: (index, ranges of lines), each index once; None if the reply can't be read.

    A reply is a JSON array, alone, between tags, or under `ranked_indices`, of integers or of objects with `index` and
    `ranges`. What is neither is passed over, and so is a range that is no pair of lines in order."""
    tagged = _TAGGED.search(reply)
    try:
        found = json.loads(tagged[1] if tagged else reply)
    except ValueError:
        return None
    if isinstance(found, dict):
        found = found.get("ranked_indices")
    if not isinstance(found, list):
        return None
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    out: dict[int, list[tuple[int, int]]] = {}
    for x in found:
        index, ranges = (x.get("index"), x.get("ranges") or []) if isinstance(x, dict) else (x, [])
        if whole(index) and index not in out:
            out[index] = [(a, b) for r in (ranges if isinstance(ranges, list) else []) if isinstance(r, list) and len(r) == 2 for a, b in [r] if whole(a) and whole(b) and 1 <= a <= b]
    return list(out.items())


def reranked(candidates: DataFrame, reply: str) -> DataFrame:
    """Candidates (place, line_start, line_end, ..), place from 0, that a reply names, with their new place from 0, ranges, and
    fallback. A reply that can't be read leaves all in their order, with fallback; an empty list is a reply.

    ranges: of chunks of LEAST_PRUNED lines and more the selected lines, padded and cut to the chunk; null for the whole chunk."""
    found = selections(reply)
    none = F.lit(None).cast("array<struct<a:int,b:int>>")
    if found is None:
        return candidates.withColumns({"new_place": F.col("place"), "ranges": none, "fallback": F.lit(True)})
    named = candidates.sparkSession.createDataFrame([(i, n, r) for n, (i, r) in enumerate(found)], "place int, order_ int, named_ array<struct<a:int,b:int>>")
    # as many rows as the reply names
    met = candidates.join(F.broadcast(named), "place")
    a, b = F.col("line_start"), F.col("line_end")
    cut = F.transform("named_", lambda r: F.struct(F.greatest(r["a"] - RANGE_PAD, a).cast("int").alias("a"), F.least(r["b"] + RANGE_PAD, b).cast("int").alias("b")))
    inside = F.array_sort(F.filter(cut, lambda r: r["a"] <= r["b"]))
    pruned = (b - a + 1 >= LEAST_PRUNED) & (F.size(inside) > 0)
    new = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("order_")) - 1  # of as many rows
    return met.withColumns({"new_place": new, "ranges": F.when(pruned, inside), "fallback": F.lit(False)}).drop("order_", "named_")


def added(held: DataFrame, more: DataFrame, size: Column, budget: int) -> DataFrame:
    """Chunks (file, line_start, line_end, at, ..) that an answer holds, and further ones in order of `at` that are new and fit
    what is left of a budget of characters. What doesn't fit ends the list."""
    key = ["file", "line_start", "line_end"]
    new = more.join(held.select(*key), key, "left_anti")
    first = new.withColumn("n_", F.row_number().over(Window.partitionBy(*key).orderBy("at"))).where("n_ = 1").drop("n_")
    used = F.broadcast(held.agg(F.coalesce(F.sum(size), F.lit(0)).alias("used_")))  # one row
    placed = first.join(used).withColumn("so_far_", F.sum(size).over(Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    return held.unionByName(placed.where(F.col("used_") + F.col("so_far_") <= budget).select(*held.columns))


def readiness(status: DataFrame, now: Column, stale_seconds: int = 86_400) -> DataFrame:
    """status (mutating, chunks, resolving, indexed_at) with what a search may do."""
    old = F.unix_timestamp(now) - F.unix_timestamp("indexed_at") > stale_seconds
    state = F.when(F.col("mutating") | (F.col("chunks") == 0), "wait").when(F.col("resolving"), "vectors_only").when(F.col("indexed_at").isNull(), "serve_and_refresh").when(old, "reindex").otherwise("serve")
    return status.withColumn("state", state)
