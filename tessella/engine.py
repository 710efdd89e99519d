"""A code index from a source tree, its upkeep, and what can be asked of it.

`build` reads a tree and commits its tables; `update` reads what changed since and commits that; the verbs answer from the last
commit. Embedders and rerankers are given by the user: anything that has the methods below."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import answer, evaluation, filters, graph, incremental, intervals, lexical, resolve, vector
from tessella.operators.index import Bus, Index
from tessella.sources import frameworks, repository

CHUNKER = 1
TABLES = ("file_meta", "chunk", "vector", "symbol", "raw_edge")


class Embedder(Protocol):
    """Makes vectors of texts; `identity` changes whenever its vectors do."""

    identity: str
    dim: int

    def embed(self, content: Column) -> Column: ...


class Reranker(Protocol):
    """Answers a prompt with a reply as `evaluation.selections` reads it."""

    def reply(self, query: str, entries: list[str]) -> str: ...


@dataclass
class HashedWords:
    """An embedder without a model: each word and part of a name adds one to a place that its hash gives. Built-in functions only."""

    dim: int = 64
    identity: str = "local|hashed-words|64"

    def embed(self, content: Column) -> Column:
        words = F.filter(F.split(text.identifier_words(content), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(self.dim)).cast("int"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("float"))
        return counts


class Engine:
    def __init__(self, spark: SparkSession, root: str, index_root: str, embedder: Embedder | None = None, reranker: Reranker | None = None) -> None:
        self.spark, self.root = spark, root
        self.embedder, self.reranker = embedder or HashedWords(), reranker
        self.events = Bus()
        self.index = Index(spark, index_root, self.events)

    # building

    def _tables(self, files: DataFrame) -> dict[str, DataFrame]:
        """The rows of files (file, size, mtime, text) in each table."""
        rows = repository.extracted(files)
        symbols = repository.symbols(rows)
        chunks = repository.chunks(rows, files)
        held = intervals.deepest(chunks, symbols)
        edges = repository.references(rows)
        own = files.select(F.lit("").alias("repo"), "file", "text")
        made = frameworks.framework_edges(own)
        made = made.select(F.concat_ws(":", "framework", "from_fqn", "to_name", "line").alias("edge_id"), F.col("file").alias("from_file"), "from_fqn", "to_name", F.lit(None).cast("string").alias("import_path"), "line", "confidence", F.lit(None).cast("string").alias("flow_type"))
        return {
            "chunk": held, "symbol": symbols, "raw_edge": edges.unionByName(made.dropDuplicates(["edge_id"])).withColumn("file", F.col("from_file")),
            "vector": chunks.select("file", "line_start", "line_end", self.embedder.embed(F.col("content")).alias("embedding")),
            "file_meta": files.select("file", "size", "mtime", F.lit(CHUNKER).alias("chunker_version")),
        }

    def _listed(self) -> DataFrame:
        return repository.walk(self.spark, self.root, ignored=tuple(self.ignored()))

    def build(self, run: str = "build") -> int:
        """Commits all of the tree. The files' meta data are written with the rest; the commit comes last."""
        files = self._listed().where("text is not null")
        return self.index.apply(run, self.embedder.identity, files.select("file", F.lit(False).alias("deleted")), self._tables(files))

    def changes(self) -> DataFrame:
        """(path, kind) between the tree and the index, where the manifest of an ecosystem touches all of its files."""
        listed = self._listed().where("text is not null")
        meta = self.index.read("file_meta")
        found = incremental.changes(listed.select(F.col("file").alias("path"), "mtime", "size"), meta.withColumnRenamed("file", "path"), CHUNKER)
        wide = incremental.widened(found.select(F.col("path").alias("file")), listed.select("file"), MANIFESTS)
        return wide.select(F.col("file").alias("path")).join(found, "path", "left").select("path", F.coalesce("kind", F.lit("modified")).alias("kind"))

    def update(self, run: str) -> int:
        """Commits what changed since the last commit: a run that is cut off may be repeated, and one without changes commits nothing."""
        changed = self.changes().select(F.col("path").alias("file"), (F.col("kind") == "deleted").alias("deleted"))
        if changed.isEmpty():
            return self.index.last()[0]
        files = self._listed().where("text is not null").join(changed.where("NOT deleted"), "file", "left_semi")
        return self.index.apply(run, self.embedder.identity, changed, self._tables(files))

    # what the commit holds

    def symbols(self) -> DataFrame:
        return self.index.read("symbol")

    def calls(self) -> DataFrame:
        """(in_name, out_name, in_file, out_file, line, confidence): edges whose names are known."""
        edges = self.index.read("raw_edge")
        found = resolve.resolved(edges, self.symbols())
        return edges.join(found, "edge_id").select(F.col("from_fqn").alias("in_name"), "out_name", F.col("from_file").alias("in_file"), "out_file", "line", "confidence")

    def ignored(self, files: list[str] | None = None) -> list[str]:
        """The paths that a user has left out; with a list, sets them."""
        if files is not None:
            self.index.put("ignored", json.dumps(files))
        return json.loads(self.index.get("ignored") or "[]")

    def status(self, mutating: bool = False, stale_seconds: int = 7 * 86_400) -> str:
        """What a search may do just now: wait, serve, or serve and index again."""
        last, _ = self.index.last()
        chunks = self.index.read("chunk").count() if last else 0
        at = self.spark.read.format("binaryFile").load(f"{self.index.root}/commit/*.parquet").agg(F.max("modificationTime").alias("t")).first()["t"] if last else None
        row = self.spark.createDataFrame([(mutating, chunks, False, at)], "mutating boolean, chunks long, resolving boolean, indexed_at timestamp")
        return evaluation.readiness(row, F.current_timestamp(), stale_seconds).first()["state"]

    def counted(self) -> dict[str, int]:
        """The four numbers of stats, counted once for each commit."""
        key = f"stats:{self.index.last()[0]}"
        if not (found := self.index.get(key)):
            found = json.dumps(self.stats().first().asDict())
            self.index.put(key, found)
        return json.loads(found)

    def stats(self) -> DataFrame:
        """One row: files, chunks, symbols, edges."""
        counts = [self.index.read(t).agg(F.count("*").alias(n)) for t, n in (("file_meta", "files"), ("chunk", "chunks"), ("symbol", "symbols"), ("raw_edge", "edges"))]
        out = counts[0]
        for c in counts[1:]:
            out = out.join(F.broadcast(c))  # tables of one row
        return out

    # verbs

    def candidates(self, query: str, top_k: int = 30) -> DataFrame:
        """(file, line_start, line_end, score, content, fqn, kind): the fused list of vectors and words, filtered and fenced."""
        words, wanted = filters.parse(query)
        chunks = self.index.read("chunk").select("file", "line_start", "line_end", "content", "fqn")
        probe = self.spark.createDataFrame([(words,)], "content string").select(self.embedder.embed(F.col("content")).alias("embedding"))
        near = vector.topk(self.index.read("vector"), probe, "file", 2 * top_k)
        one = Window.partitionBy(F.lit(0))  # of two lists of 2 x top_k rows at most
        terms = self.spark.createDataFrame([(words,)], "q string").select(text.terms(F.col("q")).alias("t")).first()["t"]
        v = near.withColumn("rank", F.row_number().over(one.orderBy(F.desc("score"), *answer.KEY)))
        if terms:
            pooled = lexical.pools(chunks.withColumn("symbol", F.col("fqn")), terms, lexical.pool_limit(top_k))
            w = lexical.ranked(lexical.scored(pooled, terms), 2 * top_k).withColumn("rank", F.row_number().over(one.orderBy(F.desc(F.round("score", 9)), F.length("content"), *lexical.KEY)))
            fused = lexical.rrf(v, w)
        else:
            fused = lexical.rrf(v, v.limit(0))
        best = fused.orderBy(*lexical.fused_order()).limit(2 * top_k)
        held = answer.hydrated(best, chunks, self.symbols())
        held = held.withColumns({"lang": repository.paths.language(F.col("file")), "name": F.substring_index("fqn", "::", -1)})
        held = held.where(wanted.condition(path="file", lang="lang", kind="kind"))
        held = filters.by_name(held, wanted.names, "name") if wanted.names else held
        return held.orderBy(F.desc("rrf"), *answer.KEY).limit(top_k)

    def retrieve(self, query: str, top_k: int = 30, budget: int = answer.ANSWER_CHARS - answer.FOOTER_CHARS) -> DataFrame:
        """(place, file, line_start, line_end, whole, body): blocks of an answer, the graph's neighbours among them."""
        found = self.candidates(query, top_k)
        if self.reranker:
            found = self._reranked(query, found)
        seeds = found.where("fqn is not null").groupBy("fqn").agg(F.max("score").alias("score"))
        bonus = graph.expand(self.calls(), seeds)
        places = self.symbols().select("fqn", "file", "line_start", "line_end")
        more = intervals.first_overlap(bonus.join(places, "fqn"), self.index.read("chunk")).join(bonus, "fqn")
        chunk_ends = self.index.read("chunk").select("file", F.col("line_start").alias("chunk_start"), F.col("line_end").alias("chunk_end"))
        more = more.join(chunk_ends, ["file", "chunk_start", "chunk_end"]).select("file", F.col("chunk_start").alias("line_start"), F.col("chunk_end").alias("line_end"), "score")
        ranges = answer.merged(answer.united(found, more))
        return self._shown(ranges, budget)

    def _reranked(self, query: str, found: DataFrame) -> DataFrame:
        rows = found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rrf"), *answer.KEY)) - 1)
        listed = rows.orderBy("place").collect()  # top_k rows
        entries = [f"[{r.place}] {r.file}:{r.line_start}-{r.line_end} score={r.score:.2f}\n{r.content}" for r in listed]
        told = evaluation.reranked(rows, self.reranker.reply(query, entries))
        whole = F.array(F.struct(F.col("line_start").cast("int").alias("a"), F.col("line_end").cast("int").alias("b")))
        cut = told.withColumn("r", F.explode(F.coalesce("ranges", whole)))
        score = F.when(F.col("fallback"), F.col("score")).otherwise(1.0 - F.col("new_place") / 1000.0)
        return cut.select("file", F.col("r.a").alias("line_start"), F.col("r.b").alias("line_end"), score.alias("score"), "content", "fqn", "kind")

    def _shown(self, ranges: DataFrame, budget: int) -> DataFrame:
        files = self._listed().where("text is not null").select("file", "text")
        lines = F.slice(F.split(text.redacted(F.col("text")), "\n"), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1)
        shown = ranges.join(files, "file").select(*answer.KEY, "score", text.numbered(F.array_join(lines, "\n"), F.col("line_start")).alias("body"))
        best = [F.desc(F.round("score", 9)), F.col("file"), F.col("line_start")]
        placed = answer.within(shown.withColumn("one_", F.lit(1)), "one_", best, F.length("body"), budget)
        body = F.when(F.col("whole"), F.col("body")).otherwise(F.substring_index("body", "\n", 1))
        return placed.select(F.row_number().over(Window.partitionBy("one_").orderBy(*best)).alias("place"), *answer.KEY, "whole", body.alias("body"))

    def retrieve_file(self, file: str, query: str, top_k: int = 10) -> DataFrame:
        """(line_start, line_end, score, content): a file's chunks nearest to a query, four times as many as asked for, for a reranker."""
        probe = self.spark.createDataFrame([(query,)], "content string").select(self.embedder.embed(F.col("content")).alias("probe"))
        own = self.index.read("vector").where(F.col("file") == file).join(F.broadcast(probe))  # one row
        scored = own.select(*answer.KEY, F.round(vector.cosine(F.col("embedding"), F.col("probe")), 6).alias("score")).orderBy(F.desc("score"), "line_start").limit(4 * top_k)
        return scored.join(self.index.read("chunk").select(*answer.KEY, "content"), list(answer.KEY)).drop("file")

    def find(self, reference: str) -> DataFrame:
        return resolve.by_reference(self.symbols(), reference)

    def _one(self, reference: str) -> str:
        found = [r["fqn"] for r in self.find(reference).select("fqn").distinct().limit(11).collect()]
        if len(found) != 1:
            raise LookupError(f"{reference} is no symbol" if not found else f"{reference} may be " + ", ".join(sorted(found)[:10]))
        return found[0]

    def trace(self, start: str, goal: str, direction: str = "callees") -> DataFrame:
        return graph.trace(self.calls(), self._one(start), self._one(goal), direction)

    def impact(self, reference: str, depth: int = graph.IMPACT_DEPTH) -> DataFrame:
        seeds = self.spark.createDataFrame([(self._one(reference),)], "seed string")
        return graph.impact(self.calls(), seeds, min(depth, 8), budget=graph.IMPACT_NODES)

    def changes_impact(self, diff: str, depth: int = 2, most_files: int | None = 64) -> DataFrame:
        """What reaches the symbols that a unified diff touches; of its files the first so many, or all for None."""
        runs = intervals.added_runs(repository.diff_lines(self.spark.createDataFrame([(0, diff)], "diff int, text string")))
        if most_files is not None:
            runs = runs.join(runs.select("file").distinct().orderBy("file").limit(most_files), "file", "left_semi")
        changed = intervals.changed_symbols(runs, self.symbols()).select("fqn").distinct()
        return graph.reached(self.calls(), changed, max(1, min(depth, 5)))

    def context(self, reference: str) -> DataFrame:
        """(fqn, text): a symbol's place, definition, callers and callees."""
        fqn = self._one(reference)
        own = self.symbols().where(F.col("fqn") == fqn)
        files = self._listed().where("text is not null").select("file", "text")
        lines = F.slice(F.split("text", "\n"), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1)
        source = own.join(files, "file").select("fqn", text.numbered(text.redacted(F.array_join(lines, "\n")), F.col("line_start")).alias("content"))
        calls = self.calls()
        near = calls.where((F.col("in_name") == fqn) | (F.col("out_name") == fqn))
        counts = graph.caller_stats(near).select("fqn", F.col("caller_sites").alias("callers"), F.col("caller_inferred").alias("callers_inferred"), F.col("callee_sites").alias("callees"), F.col("callee_inferred").alias("callees_inferred"))
        names = [graph.proximity_list(near, self.symbols(), d).withColumnRenamed("names", n) for d, n in (("callers", "caller_names"), ("callees", "callee_names"))]
        stats = counts.join(names[0], "fqn", "left").join(names[1], "fqn", "left")
        return answer.described(own.select("fqn", "kind", *answer.KEY), source, stats)

    def grep(self, pattern: str, scope: str = "**", literal: bool = False, most: int = 200, per_file: int = 20) -> DataFrame:
        """(file, ln, body): the first matching lines of files whose path a glob takes in."""
        files = self._listed().where(F.col("text").isNotNull() & F.col("file").rlike(text.glob(scope)))
        lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("k", "body")).select("file", (F.col("k") + 1).alias("ln"), "body")
        hits = lines.where(F.col("body").rlike(re.escape(pattern) if literal else pattern))
        first = hits.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("ln"))).where(F.col("r") <= per_file).drop("r")
        return first.orderBy("file", "ln").limit(most)


#: What a changed manifest touches.
MANIFESTS = {
    "package.json": ("ts", "tsx", "js", "jsx", "mjs", "cjs", "vue", "svelte"), "pyproject.toml": ("py",), "requirements.txt": ("py",), "go.mod": ("go",), "Cargo.toml": ("rs",), "pom.xml": ("java", "kt"), "build.gradle": ("java", "kt"),
    "composer.json": ("php",), "Gemfile": ("rb",), "pubspec.yaml": ("dart",),
}


@dataclass
class Budgets:
    """What an agent may use: queries, characters of what it keeps, steps, and replies that can't be read."""

    queries: int = 8
    chars: int = 48_000
    steps: int = 12
    retries: int = 2


@dataclass
class Session:
    """What an agent has kept so far, in order, and why it ended."""

    kept: list[dict] = field(default_factory=list)
    seen: list[dict] = field(default_factory=list)
    queries: int = 0
    ended: str = ""

    def keep(self, chunk: dict, budget: int) -> bool:
        """Each chunk once, while its text fits."""
        key = lambda c: (c["file"], c["line_start"], c["line_end"])
        if any(key(c) == key(chunk) for c in self.kept):
            return False
        if sum(len(c["content"]) for c in self.kept) + len(chunk["content"]) > budget:
            return False
        self.kept.append(chunk)
        return True


class Agent(Protocol):
    """Chooses the next action: {"add": [indexes of what it has seen]}, {"query": text}, {"grep": pattern}, {"read": file}, or {"done": true}."""

    def act(self, query: str, session: Session) -> dict: ...


def explore(engine: Engine, query: str, agent: Agent, top_k: int = 10, budgets: Budgets | None = None) -> Session:
    """An agent's search: it sees candidates and keeps some, in turns, within budgets.

    What it kept is the answer; if it ends by itself with nothing kept, nothing is; if a budget ends it so, the first candidates are."""
    limits, own, failed = budgets or Budgets(), Session(), 0
    columns = [*answer.KEY, "content"]

    def see(frame: DataFrame) -> None:
        known = {(c["file"], c["line_start"], c["line_end"]) for c in own.seen}
        own.seen += [c for c in (r.asDict() for r in frame.collect()) if (c["file"], c["line_start"], c["line_end"]) not in known]

    see(engine.candidates(query, top_k).select(*columns))  # top_k rows, here and below
    first = list(own.seen)
    for _ in range(limits.steps):
        action = agent.act(query, own)
        if action.get("done"):
            own.ended = "done"
            break
        if "add" in action:
            for k in action["add"]:
                if isinstance(k, int) and 0 <= k < len(own.seen):
                    own.keep(own.seen[k], limits.chars)
        elif {"query", "grep", "read"} & set(action):
            if own.queries >= limits.queries:
                own.ended = "queries"
                break
            own.queries += 1
            if "query" in action:
                see(engine.candidates(action["query"], top_k).select(*columns))
            elif "grep" in action:
                see(engine.grep(action["grep"], most=top_k).select("file", F.col("ln").alias("line_start"), F.col("ln").alias("line_end"), F.col("body").alias("content")))
            else:
                see(engine.index.read("chunk").where(F.col("file") == action["read"]).orderBy("line_start").limit(top_k).select(*columns))
        else:
            failed += 1
            if failed > limits.retries:
                own.ended = "format"
                break
    own.ended = own.ended or "steps"
    if not own.kept and own.ended != "done":
        own.kept = first
    return own
