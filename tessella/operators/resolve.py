"""References to symbols: the ranked join of raw edges with symbols by leaf name, import paths, taint.

A hot name is never joined with all its symbols: the best candidate is aggregated for each key that a level needs, and what
the edges ask for, each once, joins those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.paths import is_generated, language, parent, slashed
from tessella.sources.shared import written

#: By language, what an import may end in, in order.
PROBES = {
    "typescript": (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", ""),
    "python": (".py", "/__init__.py", ""),
    "rust": (".rs", "/mod.rs", ""),
}
PROBES |= {"tsx": PROBES["typescript"], "javascript": PROBES["typescript"]}
LOOKED_UP = 200


def normal_path(path: Column) -> Column:
    """Without `.` and with `..` taken back; what would leave the root is dropped."""
    parts = F.filter(F.split(slashed(path), "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    back = lambda s: F.when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
    kept = F.aggregate(parts, none, lambda s, p: F.when(p == "..", back(s)).otherwise(F.concat(s, F.array(p))))
    return F.concat(F.when(slashed(path).startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def tries(imports: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of imports (keep, import_path, from_file) as (keep, rank, suffix, whole): the endings to try, in order.

    Whole suffixes are paths of relative imports; others may follow any prefix. Languages without rules give no rows."""
    endings = F.create_map(*[x for name, e in PROBES.items() for x in (F.lit(name), F.array(*map(F.lit, e)))])
    path, lang, here = F.col("import_path"), F.col("lang_"), F.concat(F.col("here_"), F.lit("/"))
    rows = imports.where("import_path is not null").select(*keep, "import_path", language(F.col("from_file")).alias("lang_"), parent(F.col("from_file")).alias("here_"))
    rows = rows.where(lang.isin(*PROBES)).withColumn("dots_", F.length(F.regexp_extract(path, r"^(\.+)", 1)))
    plain = F.regexp_replace(path, r"^(crate|self|super)::", "")
    joined = (
        F.when((lang == "python") & (F.col("dots_") > 0) & ~path.rlike(r"^\.\.?/"), F.concat(here, F.repeat(F.lit("../"), F.col("dots_") - 1), F.translate(F.regexp_replace(path, r"^\.+", ""), ".", "/")))
        .when(F.col("dots_") > 0, F.concat(here, F.when(lang == "python", F.regexp_replace(path, r"\.py$", "")).otherwise(path)))
        .when((lang == "rust") & path.rlike("^(self|super)::"), F.concat(here, F.replace(plain, F.lit("::"), F.lit("/"))))
    )
    loose = F.when(lang == "python", F.translate(path, ".", "/")).when(lang == "rust", F.replace(plain, F.lit("::"), F.lit("/"))).otherwise(path)
    rows = rows.select(*keep, "lang_", joined.alias("joined_"), loose.alias("loose_")).select(*keep, "lang_", F.col("joined_").isNotNull().alias("whole"), F.coalesce(normal_path(F.col("joined_")), "loose_").alias("base_"))
    return rows.select(*keep, "whole", "base_", F.posexplode(endings[lang]).alias("rank", "ending_")).select(*keep, "rank", F.concat("base_", "ending_").alias("suffix"), "whole")


def _tried(asked: DataFrame) -> DataFrame:
    """(import_path, from_file, rank, suffix, whole): the endings of each path and importing file of the rows asked, each pair once.

    Pairs are written first: a filter on endings would be moved below their distinct, and endings be made for every row."""
    pairs = written(asked.where("import_path is not null").select("import_path", "from_file").distinct(), "pairs")
    return written(tries(pairs.withColumn("path_", F.col("import_path")), ["path_", "from_file"]).withColumnRenamed("path_", "import_path"), "tries")


def _tail(path: Column) -> Column:
    """What follows the first slash: the part of a suffix that must equal a path's last components. Null without a slash."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "^[^/]*/", ""))


def _tails(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/"))


def best_ending(wanted: DataFrame, places: DataFrame, order: Column) -> DataFrame:
    """Rows of wanted (name, suffix, whole) with c: the least by `order` of the places (name, file, ..) of that name whose file
    ends with the suffix, or, if whole, is it.

    A suffix with a slash is joined by what must equal the last components of a path. One without meets the best place of
    each base name: a name that is everywhere has as many rows there as its files have different names, not as it has places."""
    far = wanted.where(F.contains("suffix", F.lit("/"))).withColumn("tail_", _tail(F.col("suffix")))
    keyed = places.select("*", F.explode(F.array_distinct(_tails(F.col("file")))).alias("tail_"))
    met = far.join(keyed, ["name", "tail_"]).where(F.when(F.col("whole"), F.col("file") == F.col("suffix")).otherwise(F.endswith("file", F.col("suffix"))))
    by_far = met.groupBy("name", "suffix", "whole").agg(F.min(order).alias("c"))
    near = wanted.where(~F.contains("suffix", F.lit("/")))
    base, whole = F.substring_index("file", "/", -1), ~F.contains("file", F.lit("/"))
    bases = places.groupBy("name", base.alias("base_")).agg(F.min(order).alias("c"), F.min(F.when(whole, order)).alias("own"))
    endings = F.transform(F.sequence(F.lit(1), F.length("base_")), lambda i: F.substring(F.col("base_"), i, F.length("base_")))
    ends = bases.select("name", "base_", "c", "own", F.explode(endings).alias("suffix"))
    by_near = near.join(ends, ["name", "suffix"]).withColumn("c", F.when(~F.col("whole"), F.col("c")).when(F.col("suffix") == F.col("base_"), F.col("own"))).groupBy("name", "suffix", "whole").agg(F.min("c").alias("c"))
    return by_far.unionByName(by_near).where("c is not null")


def import_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (import_id, import_path, from_file) with file: the first ending that some file has, and of its files the least."""
    key = ["import_path", "from_file"]
    wanted = _tried(imports)
    every = files.select("file").distinct()
    got = [*key, "rank", "file"]
    whole = wanted.where("whole").join(every, F.col("suffix") == F.col("file")).select(*got)
    loose = wanted.where("not whole").join(_suffix_files(wanted.where("not whole").select("suffix").distinct(), every), "suffix").select(*got)
    best = whole.unionByName(loose).groupBy(*key).agg(F.min(F.struct("rank", "file")).alias("b"))
    # what is alike in path and importing file is looked up once; written, so that a small table is known to be small
    return imports.join(written(best.select(*key, "b.file"), "found"), key).select(*imports.columns, "file")


def _suffix_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(suffix, file): the least file that ends with each suffix."""
    keyed = files.select("file", F.explode(_tails(F.col("file"))).alias("key"))
    slashed_ = wanted.where(F.contains("suffix", F.lit("/"))).withColumn("key", _tail(F.col("suffix"))).join(keyed, "key").where(F.endswith("file", F.col("suffix"))).select("suffix", "file")
    # a bare ending meets base names only: as many as there are distinct ones
    bases = files.select(F.substring_index("file", "/", -1).alias("base"), "file").groupBy("base").agg(F.min("file").alias("file"))
    bare = wanted.where(~F.contains("suffix", F.lit("/")))
    endings = bases.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.length("base")), lambda i: F.substring(F.col("base"), i, F.length("base")))).alias("suffix"))
    return slashed_.unionByName(bare.join(endings, "suffix").select("suffix", "file")).groupBy("suffix").agg(F.min("file").alias("file"))


def _above(file: Column) -> Column:
    """The folders that a file lies in, the root as ''."""
    parts = F.split(file, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def _below(folder: Column, path: Column) -> Column:
    return normal_path(F.concat_ws("/", F.when(folder != "", folder), path))


def go_files(imports: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """imports (import_id, import_path, from_file) of Go with file: the first one of the folder that the path names below the
    module (folder, module) of the nearest go.mod above the importing file."""
    own = imports.where((language(F.col("from_file")) == "go") & F.col("import_path").isNotNull())
    near = own.select("*", F.explode(_above(F.col("from_file"))).alias("folder")).join(modules, "folder").groupBy(*imports.columns).agg(F.max_by(F.struct("folder", "module"), F.length("folder")).alias("m"))
    path, module = F.col("import_path"), F.col("m.module")
    inside = near.where((path == module) | path.startswith(F.concat(module, F.lit("/"))))
    wanted = inside.withColumn("dir_", _below(F.col("m.folder"), F.substring(path, F.length(module) + 2, F.length(path)))).drop("m")
    first = files.where(F.endswith("file", F.lit(".go"))).groupBy(parent(F.col("file")).alias("dir_")).agg(F.min("file").alias("file"))
    return wanted.join(first, "dir_").select(*imports.columns, "file")


def alias_files(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports (import_id, import_path, from_file) with file, by aliases (folder, n, pattern, target) in order of n, as `@/*` and
    `src/*`, of the nearest configuration above the importing file. Relative and absolute paths have none."""
    lang, path = language(F.col("from_file")), F.col("import_path")
    own = imports.where(lang.isin("typescript", "tsx", "javascript") & ~path.rlike(r"^[./]"))
    every = aliases.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("n", "pattern", "target"))).alias("aliases"))  # one configuration's entries
    near = own.select("*", F.explode(_above(F.col("from_file"))).alias("folder")).join(every, "folder").groupBy(*imports.columns).agg(F.max_by(F.struct("folder", "aliases"), F.length("folder")).alias("m"))
    one = near.select("*", F.explode("m.aliases").alias("a"))
    prefix, base = F.regexp_replace("a.pattern", r"\*$", ""), F.regexp_replace("a.target", r"\*$", "")
    met = one.where(F.endswith("a.pattern", F.lit("*")) & path.startswith(prefix))
    rest = F.substring(path, F.length(prefix) + 1, F.length(path))
    tried = met.select(*imports.columns, F.col("a.n").alias("n"), _below(F.col("m.folder"), F.concat(base, rest)).alias("base_")).select("*", F.posexplode(F.array(*map(F.lit, PROBES["typescript"]))).alias("rank", "end_"))
    placed = tried.withColumn("found_", F.concat("base_", "end_")).join(files.select(F.col("file").alias("found_")).distinct(), "found_")
    return placed.groupBy(*imports.columns).agg(F.min_by("found_", F.struct("n", "rank")).alias("file"))


def projected(edges: DataFrame) -> DataFrame:
    """Edges (what, to_name, ..) as they are stored: calls and flows only, both of kind `calls`, flows with their type."""
    flow = F.when(F.startswith("to_name", F.lit("taint:source:")), "taint_source").when(F.startswith("to_name", F.lit("taint:sink:")), "taint_sink").otherwise("data_flows_to")
    return edges.where("what IN ('call', 'flow')").withColumns({"kind": F.lit("calls"), "flow_type": F.when(F.col("what") == "flow", flow)}).drop("what")


#: Fixed value: names of files that hand on what their neighbours define.
BARREL = r"/(index\.[jt]sx?|__init__\.py|mod\.rs)$"


def chase(resolved: DataFrame, files: DataFrame, depth: int = 8) -> DataFrame:
    """resolved (import_id, file, symbol) with the file that a barrel stands for: a sibling named as the symbol, or a barrel below."""
    every = files.select(F.col("file").alias("next_")).distinct()
    now = resolved.withColumn("done_", ~F.col("file").rlike(BARREL))
    for _ in range(min(depth, 2)):  # a barrel below is named by the symbol as well: it can't repeat more often
        folder = F.regexp_replace("file", r"/[^/]*$", "")
        ends = F.when(F.col("file").rlike(r"\.tsx?$"), F.array(*map(F.lit, (".ts", ".tsx", ".js", ".jsx")))).when(F.col("file").rlike(r"\.jsx?$"), F.array(*map(F.lit, (".js", ".jsx", ".ts", ".tsx")))).when(F.col("file").endswith(".py"), F.array(F.lit(".py"))).otherwise(F.array(F.lit(".rs")))
        named = F.flatten(F.transform(ends, lambda e: F.array(F.concat(folder, F.lit("/"), F.col("symbol"), e), F.concat(folder, F.lit("/"), F.lower("symbol"), e))))
        below = F.transform(ends, lambda e: F.concat(folder, F.lit("/"), F.col("symbol"), F.lit("/index"), e))
        tries = now.where("not done_").select("import_id", F.posexplode(F.concat(named, below)).alias("rank", "next_"))
        best = tries.join(every, "next_").groupBy("import_id").agg(F.min(F.struct("rank", "next_")).alias("b"))
        now = now.join(best, "import_id", "left").select("import_id", "symbol", F.coalesce("b.next_", "file").alias("file"), (F.col("done_") | F.col("b").isNull() | ~F.coalesce("b.next_", "file").rlike(BARREL)).alias("done_"))
    return now.drop("done_")


def resolved(edges: DataFrame, symbols: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Edges whose name is known, with the level by which the symbol was chosen, its fqn and file, and the columns of `keep`.

    Levels: 0 the import's file, 1 a path ending in the import, 2 the same folder, 3 the same file, 4 any. At each but 3 a
    file that no tool wrote goes first; then the first by file and lines. Tainted edges pass through with no file.

    What is alike in name, importing file and import path is resolved once. Of the symbols only those whose name some edge
    has are looked at, and of each name and file only the first: no level can choose another."""
    taint = F.startswith("to_name", F.lit("taint:"))
    plain = edges.where(~taint)
    asked = ["to_name", "from_file", "import_path"]
    every = written(plain.select(*asked).distinct().select(F.col("to_name").alias("name"), "from_file", "import_path"), "asked")
    named = symbols.join(every.select("name").distinct(), "name", "left_semi")
    first = named.groupBy("name", "file").agg(F.min(F.struct("line_start", "line_end", "fqn")).alias("p")).select("name", "file", "p.*")
    s = written(first.withColumns({"made": is_generated(F.col("file")).cast("int"), "folder": parent(F.col("file"))}), "places")
    e = every.join(s.select("name").distinct(), "name", "left_semi").withColumn("slash", F.contains("import_path", F.lit("/")))
    by_place, by_hand = F.struct("file", "line_start", "line_end", "fqn"), F.struct("made", "file", "line_start", "line_end", "fqn")
    level4 = s.groupBy("name").agg(F.min(by_hand).alias("c4"))
    level3 = s.select("name", F.col("file").alias("from_file"), by_place.alias("c3"))
    level2 = s.groupBy("name", "folder").agg(F.min(by_hand).alias("c2"))
    key = ["name", "from_file", "import_path"]
    tried = e.join(_tried(e), ["import_path", "from_file"])
    found0 = best_ending(tried.select("name", "suffix", "whole").distinct(), s, by_place)
    level0 = tried.join(found0, ["name", "suffix", "whole"]).groupBy(*key).agg(F.min_by("c", "rank").alias("c0"))
    ends = e.where("slash").select("name", F.col("import_path").alias("suffix"), F.lit(False).alias("whole")).distinct()
    level1 = best_ending(ends, s, by_hand).select("name", "suffix", F.col("c").alias("c1"))
    joined = (
        e.join(level4, "name")
        .join(level3, ["name", "from_file"], "left")
        .withColumn("folder", F.when(~F.col("slash"), parent(F.col("from_file")))).join(level2, ["name", "folder"], "left")
        .withColumn("suffix", F.when(F.col("slash"), F.col("import_path"))).join(level1, ["name", "suffix"], "left")
        .join(level0, key, "left")
    )
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"c{i}.fqn").alias("fqn"), F.col(f"c{i}.file").alias("file")) for i in range(5)])
    chosen = F.element_at(F.filter(levels, lambda x: x["fqn"].isNotNull()), 1)
    told = joined.select(*[F.col(k).alias(f"{k}_") for k in key], chosen.alias("x"))
    same = (F.col("to_name") == F.col("name_")) & F.col("from_file").eqNullSafe(F.col("from_file_")) & F.col("import_path").eqNullSafe(F.col("import_path_"))
    done = plain.select("edge_id", *{*asked, *keep}).join(told, same).select("edge_id", *keep, "x.level", F.col("x.fqn").alias("out_name"), F.col("x.file").alias("out_file"))
    tainted = edges.where(taint).select("edge_id", *keep, F.lit(-1).alias("level"), F.col("to_name").alias("out_name"), F.lit("").alias("out_file"))
    return done.unionByName(tainted)


def by_reference(symbols: DataFrame, reference: str) -> DataFrame:
    """Symbols that a reference means: an exact fqn alone, else those that end in it, else those of that name."""
    leaf = reference.rsplit("::", 1)[-1]
    exact, tail, name = F.col("fqn") == reference, F.endswith("fqn", F.lit("::" + reference.lstrip(":"))), F.col("name") == leaf
    rank = F.when(exact, 0).when(tail, 1).when(name, 2)
    found = symbols.withColumn("rank_", rank).where("rank_ is not null")
    best = F.broadcast(found.agg(F.min("rank_").alias("rank_")))  # one row
    return found.join(best, "rank_").drop("rank_").orderBy("fqn").limit(LOOKED_UP)


def tainted(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Calls (lang, callee) of a catalogue (lang, callee, role, tag) as targets taint:<role>:<tag>, of confidence 0.95."""
    return calls.join(catalogue, ["lang", "callee"]).select(*calls.columns, F.concat_ws(":", F.lit("taint"), "role", "tag").alias("to_name"), F.lit(0.95).alias("confidence"))
