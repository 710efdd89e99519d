"""Graph operators over call sites: neighbours, impact, paths, scored expansion, hubs, export, components.

Edges are rows (in_name, out_name, in_file, out_file, line, confidence); a null confidence is an extracted edge, of weight 1.
Loops run on the driver over a bounded depth. Edges and each hop's frontier are written to the shared folder, so a hop reads
two tables, whatever came before it, and a lost executor repeats no more than a hop. Nothing is cached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import call_names
from tessella.operators import components as joined
from tessella.sources.shared import written

NEIGHBOURS, IMPACT_DEPTH, IMPACT_NODES, TRACE_DEPTH, PATHS = 32, 3, 512, 5, 3
CALLER, CALLEE, FLOOR, BONUS = 0.6, 0.5, 0.15, 30
HUBS, HUB_EDGES = 250, 600


def weight(confidence: str = "confidence") -> Column:
    return F.coalesce(F.col(confidence), F.lit(1.0))


def strongest(calls: DataFrame) -> DataFrame:
    """One edge for each pair of names: extracted beats inferred, else the largest confidence."""
    best = calls.groupBy("in_name", "out_name").agg(F.max(weight()).alias("weight"), F.min("in_file").alias("in_file"), F.min("out_file").alias("out_file"))
    return best.withColumn("confidence", F.when(F.col("weight") < 1.0, F.col("weight")))


def _turned(calls: DataFrame, direction: str) -> DataFrame:
    """(node, other, file, confidence): from a name to its callers or its callees."""
    at, to, file = ("out_name", "in_name", "in_file") if direction == "callers" else ("in_name", "out_name", "out_file")
    return calls.select(F.col(at).alias("node"), F.col(to).alias("other"), F.col(file).alias("file"), "confidence")


def neighbours(calls: DataFrame, direction: str, cap: int | None = NEIGHBOURS) -> DataFrame:
    """(node, other, file, confidence, inferred) of every name: the strongest edge an endpoint, the first so many by name and file."""
    ends = _turned(calls, direction).groupBy("node", "other").agg(F.min("file").alias("file"), F.max(weight()).alias("weight"))
    ends = ends.select("node", "other", "file", F.when(F.col("weight") < 1.0, F.col("weight")).alias("confidence"), (F.col("weight") < 1.0).alias("inferred"))
    if cap is None:
        return ends
    nth = F.row_number().over(Window.partitionBy("node").orderBy("other", "file"))
    return ends.withColumn("nth", nth).where(F.col("nth") <= cap).drop("nth")


def _hops(edges: DataFrame, seeds: DataFrame, keys: list[str], depth: int, budget: int | None) -> DataFrame:
    """(keys, fqn, depth) of what the seeds (keys, fqn) reach over written edges (node, other), at its least depth.

    budget: of each key's rows, those that are nearest, then first by name; the walk goes on from all."""
    frontier = written(seeds.select(*keys, "fqn").distinct(), "hop")
    levels = [frontier.withColumn("depth", F.lit(0))]
    for d in range(1, depth + 1):
        seen = levels[0]
        for level in levels[1:]:
            seen = seen.unionByName(level)
        step = frontier.join(edges, F.col("fqn") == F.col("node")).select(*keys, F.col("other").alias("fqn")).distinct()
        frontier = written(step.join(seen.select(*keys, "fqn"), [*keys, "fqn"], "left_anti"), "hop")
        levels.append(frontier.withColumn("depth", F.lit(d)))
    found = levels[1] if depth else levels[0].limit(0)
    for level in levels[2:]:
        found = found.unionByName(level)
    if budget is None:
        return found
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return found.withColumn("nth_", F.row_number().over(by.orderBy("depth", "fqn"))).where(F.col("nth_") <= budget).drop("nth_")


def impact(calls: DataFrame, seeds: DataFrame, depth: int = IMPACT_DEPTH, direction: str = "callers", budget: int | None = None) -> DataFrame:
    """(seed, fqn, depth) of all that reaches each seed within so many hops, at its least depth. seeds: (seed).

    budget: at most so many rows a seed, as a report shows (IMPACT_NODES is the usual one); None gives all."""
    edges = written(_turned(calls, direction).select("node", "other").distinct(), "edges")
    return _hops(edges, seeds.select("seed", F.col("seed").alias("fqn")), ["seed"], depth, budget)


def trace(calls: DataFrame, start: str, goal: str, direction: str = "callees", depth: int = TRACE_DEPTH, most: int = PATHS, cap: int | None = NEIGHBOURS) -> DataFrame:
    """(path, length): the first paths, in order of their names, that visit no name twice. Steps that can't reach the goal in time are not taken."""
    edges = written(neighbours(calls, direction, cap).select("node", "other"), "edges")
    spark = calls.sparkSession
    reach = [spark.range(1).select(F.lit(goal).alias("fqn"))]  # names from which the goal is at most k hops away
    for _ in range(depth - 1):
        before = edges.join(reach[-1].withColumnRenamed("fqn", "other"), "other", "left_semi").select(F.col("node").alias("fqn"))
        reach.append(written(before.unionByName(reach[-1]).distinct(), "reach"))
    paths = spark.range(1).select(F.array(F.lit(start)).alias("path"), F.lit(start).alias("last"))
    found = None
    for k in range(depth):
        near = edges.join(reach[depth - 1 - k].withColumnRenamed("fqn", "other"), "other", "left_semi")
        paths = paths.join(near, paths["last"] == near["node"]).where(~F.array_contains("path", F.col("other"))).select(F.concat("path", F.array("other")).alias("path"), F.col("other").alias("last"))
        paths = written(paths, "paths")
        done = paths.where(F.col("last") == goal).select("path")
        found = done if found is None else found.unionByName(done)
        paths = paths.where(F.col("last") != goal)
    return found.orderBy("path").limit(most).select(F.concat_ws(" > ", "path").alias("path"), (F.size("path") - 1).alias("length"))


def expand(calls: DataFrame, base: DataFrame, hops: int = 2, bonus: int = BONUS) -> DataFrame:
    """(fqn, score): the best-scored neighbours of base rows (fqn, score), through callers and callees; base rows are neither returned nor passed.

    A hop reads the calls as they are: what a frontier doesn't touch is neither reduced nor written."""
    ends = F.array(*[F.struct(F.col(at).alias("node"), F.col(to).alias("other"), F.lit(factor).alias("factor")) for at, to, factor in (("out_name", "in_name", CALLER), ("in_name", "out_name", CALLEE))])
    steps = calls.select(weight().alias("weight"), F.explode(ends).alias("e")).select("e.node", "e.other", (F.col("weight") * F.col("e.factor")).alias("factor"))
    start = written(base.groupBy("fqn").agg(F.max("score").alias("score")), "hop")
    frontier, found = start, None
    for _ in range(hops):
        moved = steps.join(frontier, F.col("node") == F.col("fqn")).select(F.col("other").alias("fqn"), (F.col("score") * F.col("factor")).alias("score")).where(F.col("score") >= FLOOR)
        frontier = written(moved.groupBy("fqn").agg(F.max("score").alias("score")).join(start.select("fqn"), "fqn", "left_anti"), "hop")
        found = frontier if found is None else found.unionByName(frontier)
    return found.groupBy("fqn").agg(F.max("score").alias("score")).orderBy(F.desc(F.round("score", 9)), "fqn").limit(bonus)


def hubs(calls: DataFrame, nodes: int = HUBS) -> DataFrame:
    """(fqn, degree) of the names with most call sites, of the busiest callers and callees."""
    busiest = lambda c: calls.groupBy(F.col(c).alias("fqn")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "fqn").limit(4 * nodes)
    both = busiest("out_name").unionByName(busiest("in_name"))
    return both.groupBy("fqn").agg(F.sum("degree").alias("degree")).orderBy(F.desc("degree"), "fqn").limit(nodes)


def hub_edges(calls: DataFrame, nodes: DataFrame, most: int = HUB_EDGES) -> DataFrame:
    """(in_name, out_name): distinct edges between hubs, the first so many by name."""
    names = F.broadcast(nodes.select("fqn"))  # as many rows as hubs were asked for
    inside = calls.join(names.withColumnRenamed("fqn", "in_name"), "in_name", "left_semi").join(names.withColumnRenamed("fqn", "out_name"), "out_name", "left_semi")
    return inside.select("in_name", "out_name").distinct().orderBy("in_name", "out_name").limit(most)


def _marked(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The strongest edges, with `whole`: whether both ends have a symbol."""
    known = symbols.select("fqn").distinct()
    edges = calls.groupBy("in_name", "out_name").agg(F.max(weight()).alias("weight"))
    has = lambda df, c, flag: df.join(known.select(F.col("fqn").alias(c), F.lit(True).alias(flag)), c, "left")
    return has(has(edges, "in_name", "from_"), "out_name", "to_").select("in_name", "out_name", "weight", (F.col("from_").isNotNull() & F.col("to_").isNotNull()).alias("whole"))


def export_summary(calls: DataFrame, symbols: DataFrame, max_edges: int = 100_000) -> DataFrame:
    """One row (edges, truncated, dangling) of an export, counted in one pass over all edges."""
    counted = _marked(calls, symbols).agg(F.count_if("whole").alias("n"), F.count_if(~F.col("whole")).alias("dangling"))
    return counted.select(F.least("n", F.lit(max_edges)).alias("edges"), (F.col("n") > max_edges).alias("truncated"), "dangling")


def export(calls: DataFrame, symbols: DataFrame, max_edges: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and a summary (edges, truncated, dangling). The strongest edges stay; those without a symbol at both ends are counted and left out.

    What stays is written, not what it is chosen from."""
    first = _marked(calls, symbols).where("whole").orderBy(F.desc("weight"), "in_name", "out_name").limit(max_edges)
    kept = written(first.select("in_name", "out_name", F.when(F.col("weight") < 1.0, F.col("weight")).alias("confidence")), "kept")
    ends = kept.select(F.explode(F.array("in_name", "out_name")).alias("fqn")).distinct()
    return symbols.join(ends, "fqn", "left_semi"), kept, export_summary(calls, symbols, max_edges)


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """(in_name, out_name, line): a flow chart's line for each edge, inferred ones dotted."""
    arrow = F.when(F.col("confidence").isNull(), " --> ").otherwise(" -.-> ")
    name = lambda c: F.concat(F.regexp_replace(c, r"\W", "_"), F.lit('["'), c, F.lit('"]'))
    return edges.select("in_name", "out_name", F.concat(F.lit("  "), name("in_name"), arrow, name("out_name")).alias("line"))


def mermaid(edges: DataFrame) -> DataFrame:
    """One row, text: the edges as a flow chart, inferred ones dotted. For exports of a size to look at."""
    lines = mermaid_lines(edges)
    ordered = F.array_sort(F.collect_list(F.struct("in_name", "out_name", "line")))
    return lines.agg(F.concat_ws("\n", F.lit("flowchart LR"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """(fqn, component) of names that edges (a, b) join: the least name that can be reached.

    Names are numbered once, and components are found over the numbers; each gets the least of its names in the end."""
    edges = written(joined.contracted(edges.select("a", "b").where("a <> b")).distinct(), "edges")
    names = written(edges.select(F.explode(F.array("a", "b")).alias("fqn")).distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    number = lambda c: names.select(F.col("fqn").alias(c), F.col("id").alias(f"{c}_id"))
    found = joined.components(edges.join(number("a"), "a").join(number("b"), "b").select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))
    placed = names.join(found, "id")
    least = placed.groupBy("component").agg(F.min("fqn").alias("least"))
    return placed.join(least, "component").select("fqn", F.col("least").alias("component"))


def caller_stats(calls: DataFrame) -> DataFrame:
    """Per name: call sites and files of its callers, of its callees, and whether any caller is inferred."""
    side = lambda at, file, p: calls.groupBy(F.col(at).alias("fqn")).agg(F.count("*").alias(f"{p}_sites"), F.countDistinct(file).alias(f"{p}_files"), F.bool_or(weight() < 1.0).alias(f"{p}_inferred"))
    found = side("out_name", "in_file", "caller").join(side("in_name", "out_file", "callee"), "fqn", "full")
    return found.fillna(0).fillna(False)


def _folder(file: str) -> Column:
    """What is before a path's last slash; nothing where there is none."""
    return F.left(file, F.length(file) - F.length(F.substring_index(file, "/", -1)) - 1)


#: By direction: the end of a call that is asked about, the other one, and what its columns are called by.
_ENDS = {"callers": ("out_name", "in_name", "caller"), "callees": ("in_name", "out_name", "callee")}


def call_lists(calls: DataFrame, symbols: DataFrame, directions: tuple[str, ...] = ("callers", "callees"), most: int = 30, of: DataFrame | None = None) -> DataFrame:
    """(fqn, callers, callers_inferred, caller_names, and the same of callees) of every name: its call sites, whether one is
    inferred, and the first short names of the other ends, those of the same file first, then of the same folder, then others, each once.

    Calls are read once for both directions: each goes to the symbol of its other end, then to the name that is asked about.
    of: names (fqn) that are needed; others below the least or above the largest of them are left out before anything moves."""
    near = F.when(F.col("in_file") == F.col("out_file"), 0).when(_folder("in_file") == _folder("out_file"), 1).otherwise(2)
    code = near + F.when(weight() < 1.0, call_names.INFERRED).otherwise(0)
    ends = F.array(*[F.struct(F.lit(k * call_names.SIDE).alias("side"), F.col(_ENDS[d][0]).alias("at"), F.col(_ENDS[d][1]).alias("to")) for k, d in enumerate(directions)])
    sites = calls.select(code.alias("code"), F.explode(ends).alias("e")).select("e.at", "e.to", (F.col("code") + F.col("e.side")).alias("code")).where(F.col("at").isNotNull())
    if of is not None:
        low, high = of.agg(F.min("fqn"), F.max("fqn")).first()
        sites = sites.where(F.lit(False) if low is None else F.col("at").between(low, high))
    # a symbol that is there twice has two names, but its calls count once
    first = F.row_number().over(Window.partitionBy("fqn").orderBy("name")) == 1
    names = symbols.select(F.col("fqn").alias("to"), "name", first.alias("first"))
    told = F.col("code") + F.when(F.col("first").isNull(), call_names.COUNTS).otherwise(call_names.KNOWN + F.when(F.col("first"), call_names.COUNTS).otherwise(0))
    # the name that is asked about decides the task; there its calls come together by a number, not by its text, and are listed in columns
    moved = sites.join(names.hint("shuffle_hash"), "to", "left").select("at", call_names.site(told, F.col("name")).alias("site")).repartition("at")
    near_by = moved.sortWithinPartitions(F.crc32("at")).select("at", "site")
    sides = [(d, f"{_ENDS[d][2]}_names") for d in directions]
    return near_by.mapInArrow(call_names.told(sides, most), call_names.schema(sides))


def proximity_list(calls: DataFrame, symbols: DataFrame, direction: str = "callers", most: int = 30) -> DataFrame:
    """(fqn, names): short names of callers or callees, those of the same file first, then of the same folder, then others, each once."""
    names = f"{_ENDS[direction][2]}_names"
    return call_lists(calls, symbols, (direction,), most).where(F.size(names) > 0).select("fqn", F.col(names).alias("names"))


def proximity_names(calls: DataFrame, symbols: DataFrame, most: int = 30) -> DataFrame:
    """(fqn, names): the callers of proximity_list, joined."""
    return proximity_list(calls, symbols, "callers", most).select("fqn", F.array_join("names", ", ").alias("names"))


def reached(calls: DataFrame, seeds: DataFrame, depth: int, direction: str = "callers", budget: int | None = None) -> DataFrame:
    """(fqn, depth) of what reaches any of the seeds (fqn) within so many hops, without the seeds."""
    edges = written(_turned(calls, direction).select("node", "other").distinct(), "edges")
    return _hops(edges, seeds, [], depth, budget)


#: Fixed value: endpoints in other repositories that an answer asks for.
REMOTE = 24


def remote_ends(calls: DataFrame, own: DataFrame, foreign: DataFrame, most: int = REMOTE) -> DataFrame:
    """(fqn, repo, file): names that calls lead to and only another repository has, the first so many by name.

    own: (fqn); foreign: (fqn, repo, file). A name in several repositories is taken from the first."""
    out = calls.select(F.col("out_name").alias("fqn")).distinct().join(own.select("fqn"), "fqn", "left_anti")
    first = foreign.groupBy("fqn").agg(F.min(F.struct("repo", "file")).alias("f"))
    return out.join(first, "fqn").select("fqn", "f.repo", "f.file").orderBy("fqn").limit(most)


def as_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): an export as lines of JSON, a node or an edge each."""
    line = lambda part, df: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("line"))
    return line("node", nodes).unionByName(line("edge", edges))


def area_markdown(areas: DataFrame, most: int = 5) -> DataFrame:
    """(component, text): a section for each area (component, file, n), its files by count, the first so many."""
    order = Window.partitionBy("component").orderBy(F.desc("n"), "file")
    total = areas.groupBy("component").agg(F.sum("n").alias("symbols"), F.count("*").alias("files"))
    top = areas.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    item = F.concat(F.lit("- "), "file", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    listed = top.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", item.alias("x")))), lambda y: y["x"]), "\n").alias("list"))
    head = F.concat(F.lit("## "), "component", F.lit("\n"), F.col("symbols").cast("string"), F.lit(" symbols in "), F.col("files").cast("string"), F.lit(" files\n"))
    return listed.join(total, "component").select("component", F.concat(head, F.col("list")).alias("text"))


def listed(rows: DataFrame, group: str, name: str, most: int) -> DataFrame:
    """(group, names): the first so many names of each group, and how many more there are."""
    by = Window.partitionBy(group)
    told = rows.withColumn("r_", F.row_number().over(by.orderBy(name)))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r_") <= most, F.struct("r_", F.col(name).alias("n"))))), lambda x: x["n"]), ", ")
    left = F.count("*") - most
    return told.groupBy(group).agg(F.concat(shown, F.when(left > 0, F.concat(F.lit(" +"), left.cast("string"), F.lit(" more"))).otherwise("")).alias("names"))
