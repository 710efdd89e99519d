"""Line ranges: chunking, overlap and containment joins, merges. Rows carry file, line_start, line_end; ends are inclusive."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BUDGET, MERGE_GAP, MERGE_LINES = 1500, 2, 60
#: Lines of a bucket in which ranges meet.
BUCKET = 64


def _packed(budget: int):
    @F.pandas_udf("array<struct<line_start:int,line_end:int,size:int>>")
    def pack(sizes: pd.Series) -> pd.Series:
        def one(own: np.ndarray | None) -> list[dict] | None:
            if own is None:
                return None
            out, first, total = [], 1, 0
            for at, n in enumerate(own.tolist(), 1):
                if at > first and total + n > budget:
                    out.append((first, at - 1, total))
                    first, total = at, 0
                total += n
            out.append((first, len(own), total))
            return [{"line_start": a, "line_end": b, "size": n} for a, b, n in out if n > 0]

        return sizes.map(one)

    return pack


def packed_lines(lines: Column, budget: int = CHUNK_BUDGET) -> Column:
    """array<struct(line_start, line_end, size)> of an array of lines: whole lines packed greedily up to a number of
    characters that are no space; a longer line stands alone; chunks of nothing are dropped.

    Only the lines' sizes go to Python, where a file is packed in one pass; built-in folds copy their result at each step."""
    return _packed(budget)(F.transform(lines, lambda x: F.length(F.regexp_replace(x, r"\s+", ""))))


def _buckets(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col("line_start") / BUCKET), F.floor(F.col("line_end") / BUCKET))))


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows of a file whose ranges share a line. right's columns begin with r_.

    Ranges are dealt to buckets of lines, so a long file's rows don't all meet; a pair counts in the first bucket of both."""
    r = _buckets(right).select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.col("file"), F.col("bucket_"))
    first = F.floor(F.greatest("line_start", "r_line_start") / BUCKET)
    return _buckets(left).join(r, ["file", "bucket_"]).where((F.col("line_start") <= F.col("r_line_end")) & (F.col("r_line_start") <= F.col("line_end")) & (F.col("bucket_") == first)).drop("bucket_", "r_file")


def deepest(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunks with fqn: the narrowest symbol around the whole chunk, the later start first; null if none holds it."""
    pairs = overlapping(chunks, symbols).where((F.col("r_line_start") <= F.col("line_start")) & (F.col("r_line_end") >= F.col("line_end")))
    order = F.struct((F.col("r_line_end") - F.col("r_line_start")).alias("span"), (-F.col("r_line_start")).alias("late"), F.col("r_fqn").alias("fqn"))
    best = pairs.groupBy("file", "line_start", "line_end").agg(F.min(order).alias("b"))
    return chunks.join(best, ["file", "line_start", "line_end"], "left").select(*chunks.columns, F.col("b.fqn").alias("fqn"))


def first_overlap(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(fqn, file, chunk_start, chunk_end): each symbol's first chunk."""
    found = overlapping(symbols, chunks).groupBy("fqn", "file").agg(F.min(F.struct("r_line_start", "r_line_end")).alias("c"))
    return found.select("fqn", "file", F.col("c.r_line_start").alias("chunk_start"), F.col("c.r_line_end").alias("chunk_end"))


def islands(rows: DataFrame, gap: int, keys: list[str] | None = None, **aggregates: Column) -> DataFrame:
    """Runs of ranges of which each starts at most `gap` after the furthest end before it, as one range."""
    keys = keys or ["file"]
    before = Window.partitionBy(*keys).orderBy("line_start", "line_end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys).orderBy("line_start", "line_end").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.col("line_start") > F.max("line_end").over(before) + gap, F.lit(True)).cast("int")
    marked = rows.withColumn("new_", new).withColumn("island_", F.sum("new_").over(so_far))
    out = marked.groupBy(*keys, "island_").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), *[c.alias(n) for n, c in aggregates.items()])
    return out.drop("island_")


def capped(ranges: Column, gap: int = MERGE_GAP, most: int = MERGE_LINES) -> Column:
    """A sorted array<struct(line_start, line_end, score)> merged from left to right, to at most so many lines each."""
    none = F.array().cast("array<struct<line_start:int,line_end:int,score:double>>")

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        end = F.greatest(last["line_end"], x["line_end"])
        joins = (x["line_start"] <= last["line_end"] + gap) & (end - last["line_start"] + 1 <= most)
        merged = F.struct(last["line_start"].alias("line_start"), end.alias("line_end"), F.greatest(last["score"], x["score"]).alias("score"))
        return F.when((F.size(out) > 0) & joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(ranges, none, lambda s, x: F.when(F.size(s) == 0, F.array(x)).otherwise(step(s, x)))


def merged_capped(rows: DataFrame, gap: int = MERGE_GAP, most: int = MERGE_LINES) -> DataFrame:
    """Each file's distinct ranges, of equal ones the best score, merged under the cap.

    Ranges are first cut into islands, across which nothing can merge, so that one task folds one island and not one file."""
    best = rows.groupBy("file", "line_start", "line_end").agg(F.max("score").alias("score"))
    order = Window.partitionBy("file").orderBy("line_start", "line_end")
    new = F.coalesce(F.col("line_start") > F.max("line_end").over(order.rowsBetween(Window.unboundedPreceding, -1)) + gap, F.lit(True)).cast("int")
    marked = best.withColumn("new_", new).withColumn("island_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sets = marked.groupBy("file", "island_").agg(F.array_sort(F.collect_list(F.struct(F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), F.col("score").cast("double").alias("score")))).alias("ranges"))
    return sets.select("file", F.explode(capped(F.col("ranges"), gap, most)).alias("m")).select("file", "m.line_start", "m.line_end", "m.score")


def without_contained(rows: DataFrame) -> DataFrame:
    """Rows of distinct ranges but those inside a wider one of their file: by the furthest end of those that start no later."""
    earlier = Window.partitionBy("file").orderBy("line_start", F.desc("line_end")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reach_", F.max("line_end").over(earlier)).where(F.col("reach_").isNull() | (F.col("line_end") > F.col("reach_"))).drop("reach_")


def read_page(lines: DataFrame, first: int, most: int, size: int) -> DataFrame:
    """(file, lines, next_line) of a page of each file's lines (file, ln, body): from a line on at most so many lines and bytes,
    and the line to go on from, null at the file's end."""
    by = Window.partitionBy("file")
    sized = lines.where(F.col("ln") >= first).select("file", "ln", (F.octet_length("body") + 1).alias("n"))
    placed = sized.withColumn("upto", F.sum("n").over(by.orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("upto") <= size) & (F.col("ln") < first + most)
    last = F.max(F.when(fits, F.col("ln")))
    return placed.groupBy("file").agg(F.count_if(fits).alias("lines"), F.when(F.max("ln") > last, last + 1).cast("int").alias("next_line"))


def lines_at(lines: DataFrame, step: int, most: int) -> DataFrame:
    """(file, at, ln): of the bytes 0, step, 2 step, .. of each file, at most so many, the lines (file, ln, body) that they lie in."""
    sized = lines.select("file", "ln", (F.octet_length("body") + 1).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumn("upto", upto)
    a, b = F.ceil((F.col("upto") - F.col("n")) / step), F.least(F.ceil(F.col("upto") / step), F.lit(most)) - 1
    return placed.where(a <= b).select("file", F.explode(F.sequence(a, b)).alias("k"), "ln").select("file", (F.col("k") * step).alias("at"), "ln")


def added_runs(diff: DataFrame) -> DataFrame:
    """(diff, file, line_start, line_end): runs of added lines of the new files, from rows (diff, n, body) of unified diffs.

    Deletions don't end a run; context, headers and new hunks do. A hunk whose header can't be read, or of no lines, gives nothing."""
    order = Window.partitionBy("diff").orderBy("n")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    body = F.col("body")
    header = r"^@@ -\S+ \+(\d+)(?:,(\d+))? "
    is_file, is_old, is_hunk = body.startswith("+++ "), body.startswith("--- "), body.startswith("@@")
    start = F.regexp_extract(body, header, 1).try_cast("int")
    length = F.coalesce(F.regexp_extract(body, header, 2).try_cast("int"), F.lit(1))
    path = F.regexp_replace(F.trim(F.substring(body, 5, 1 << 20)), "^b/", "")
    marked = diff.select(
        "diff", "n", F.when(is_file, "file").when(is_old, "old").when(is_hunk, "hunk").when(body.startswith("+"), "add").when(body.startswith("-") | body.startswith("\\"), "drop").when(body.startswith(" "), "same").otherwise("else").alias("what"),
        F.when(is_file, F.when(path == "/dev/null", "").otherwise(path)).alias("path_"), F.when(is_hunk, F.when((start > 0) & (length > 0), start).otherwise(0)).alias("start_"),
    )
    marked = marked.withColumns({"file": F.last("path_", True).over(so_far), "hunk_": F.sum((F.col("what") == "hunk").cast("int")).over(so_far), "base_": F.last("start_", True).over(so_far),
                                 "run_": F.sum((~F.col("what").isin("add", "drop")).cast("int")).over(so_far)})
    within = Window.partitionBy("diff", "hunk_").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("line_", F.col("base_") + F.coalesce(F.sum(F.col("what").isin("add", "same").cast("int")).over(within), F.lit(0)))
    added = placed.where((F.col("what") == "add") & (F.col("base_") > 0) & (F.col("file") != ""))
    return added.groupBy("diff", "file", "run_").agg(F.min("line_").cast("int").alias("line_start"), F.max("line_").cast("int").alias("line_end")).drop("run_")


def changed_symbols(runs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that overlap the envelope of a file's added lines."""
    hull = runs.groupBy("file").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    wide = symbols.join(hull.select("file", F.col("line_start").alias("a_"), F.col("line_end").alias("b_")), "file")
    return wide.where((F.col("line_start") <= F.col("b_")) & (F.col("line_end") >= F.col("a_"))).drop("a_", "b_")
