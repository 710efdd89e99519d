"""From candidates to an answer: what they hold, what the graph adds, blocks, tags, and the text of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import intervals

KEY = ("file", "line_start", "line_end")
#: Short names that a tag shows, lines and characters of a definition, characters of an answer and of its end.
TAG_NAMES, DEFINITION_LINES, DEFINITION_CHARS, ANSWER_CHARS, FOOTER_CHARS = 30, 200, 16_000, 48_000, 200


def hydrated(candidates: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Candidates (key, score) with content and fqn of the chunk that they name, and the kind of its symbol.

    Candidates whose chunk is gone or blank are dropped; a symbol that is gone leaves its kind null."""
    held = candidates.join(chunks.select(*KEY, "content", "fqn"), list(KEY), "left").where(F.length(F.trim("content")) >= 1)
    return held.join(symbols.select("fqn", "kind").dropDuplicates(["fqn"]), "fqn", "left")


def united(base: DataFrame, expanded: DataFrame) -> DataFrame:
    """Both lists (key, score), each chunk once with its best score and whether the base has it."""
    every = base.select(*KEY, "score", F.lit(True).alias("base")).unionByName(expanded.select(*KEY, "score", F.lit(False).alias("base")))
    return every.groupBy(*KEY).agg(F.max("score").alias("score"), F.bool_or("base").alias("base"))


def adopted_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (key, pos, and callers, caller_names, callers_inferred, callees, callee_names, callees_inferred), those that
    touch or overlap merged into one, at the first of their positions.

    Counts and names of a side come together from the block with the largest count, the first of equal ones; inferred is
    what that block says or any after it."""
    order = Window.partitionBy("file").orderBy("line_start", "pos")
    new = F.coalesce(F.col("line_start") > F.max("line_end").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int")
    marked = blocks.withColumn("new_", new).withColumn("island_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k_", F.row_number().over(order))
    group = ["file", "island_"]
    sides = ("caller", "callee")
    best = lambda s: F.max(F.struct(F.greatest(F.coalesce(f"{s}s", F.lit(0)), F.lit(0)).alias("n"), (-F.col("k_")).alias("k"), F.col(f"{s}_names").alias("names")))
    tops = marked.groupBy(*group).agg(*[best(s).alias(s) for s in sides])
    told = marked.join(tops, group)
    later = lambda s: F.bool_or(F.when(F.col("k_") >= -F.col(f"{s}.k"), F.col(f"{s}s_inferred")))
    merged = told.groupBy(*group).agg(
        F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.min("pos").alias("pos"),
        *[F.first(F.col(f"{s}.n")).alias(f"{s}s") for s in sides], *[F.first(F.col(f"{s}.names")).alias(f"{s}_names") for s in sides], *[later(s).alias(f"{s}s_inferred") for s in sides],
    )
    return merged.drop("island_")


def tag(word: str, count: Column, names: Column, inferred: Column) -> Column:
    """` [callers: a, b +2 more ~inferred]`; without names the count alone; nothing for no count."""
    shown = F.slice(names, 1, TAG_NAMES)
    left = count - F.size(shown)
    more = F.when(left > 0, F.concat(F.lit(" +"), left.cast("string"), F.lit(" more"))).otherwise("")
    long = F.concat(F.lit(f" [{word}: "), F.array_join(shown, ", "), more, F.when(inferred, " ~inferred").otherwise(""), F.lit("]"))
    bare = F.concat(F.lit(" [callers:" if word == "callers" else " [calls:"), count.cast("string"), F.lit("]"))
    return F.when(F.coalesce(count, F.lit(0)) <= 0, "").when(F.size(names) <= 0, bare).otherwise(long)


def definition(content: Column) -> Column:
    """A symbol's lines, cut to DEFINITION_LINES and DEFINITION_CHARS if there are more."""
    lines = F.split(content, "\n")
    cut = F.substring(F.array_join(F.slice(lines, 1, DEFINITION_LINES), "\n"), 1, DEFINITION_CHARS)
    return F.when((F.size(lines) > DEFINITION_LINES) | (F.length(content) > DEFINITION_CHARS), cut).otherwise(content)


def described(symbols: DataFrame, source: DataFrame, stats: DataFrame) -> DataFrame:
    """(fqn, text): a symbol's name, kind, place and definition, and its callers and callees, from symbols (fqn, kind, key),
    source (fqn, content), and stats (fqn, callers, caller_names, callers_inferred, and the same of callees)."""
    rows = symbols.join(source, "fqn", "left").join(stats, "fqn", "left")
    head = F.concat(F.lit("`"), F.col("fqn"), F.lit("`"), F.when(F.coalesce("kind", F.lit("")) != "", F.concat(F.lit(" ("), "kind", F.lit(")"))).otherwise(""), F.lit(" — "), F.col("file"), F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("\n"))
    shown, n = definition(F.col("content")), F.size(F.split("content", "\n"))
    body = F.when(F.col("content").isNull(), "\n(no source)").otherwise(
        F.concat(F.lit("\n"), shown, F.lit("\n"), F.when(shown != F.col("content"), F.concat(F.lit("\n(cut, of "), n.cast("string"), F.lit(" lines)"))).otherwise(""))
    )
    none = F.array().cast("array<string>")
    tags = [tag(w, F.coalesce(c, F.lit(0)), F.coalesce(f"{s}_names", none), F.coalesce(f"{s}s_inferred", F.lit(False))) for w, c, s in (("callers", "callers", "caller"), ("calls", "callees", "callee"))]
    lines = [F.when(x != "", F.concat(F.lit("\n"), F.ltrim(x))).otherwise("") for x in tags]
    edges = F.when(F.col("callers").isNull() & F.col("callees").isNull(), "\n(no calls known)").otherwise(F.concat(*lines))
    return rows.select("fqn", F.concat(head, body, edges).alias("text"))


def merged(candidates: DataFrame) -> DataFrame:
    """Candidates (key, score) as ranges of an answer: merged under the cap, those inside of a wider one dropped."""
    return intervals.without_contained(intervals.merged_capped(candidates))


def within(blocks: DataFrame, group: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """An answer's blocks with `whole`: in order, blocks are whole while they fit together; after the first that doesn't, none is."""
    by = Window.partitionBy(group).orderBy(*order)
    return blocks.withColumn("whole", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)) <= budget)
