"""An index as tables in generations: incremental runs, commit markers, replays, shards and the cache of vectors.

Each table lies below one root, in a folder for each generation, and has a column `file`. A run appends the rows of the files
that it touched and the list of these files; the commit is written last. A reader sees, of each file, the rows of the last
committed generation that touched it, so what a crashed run left behind is never seen, and the same run may be repeated."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: what a stamp multiplies a count by.
STAMP_PRIME = 0x0000_0100_0000_01B3
TWO_64 = 1 << 64


class Index:
    """Tables by name under a root that all executors share."""

    def __init__(self, spark: SparkSession, root: str, listener: Callable[[dict], None] | None = None) -> None:
        """listener: is told what a run does, as dicts with `run` and `stage`."""
        self.spark, self.root, self.listener = spark, root.rstrip("/"), listener or (lambda event: None)

    def _there(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p))

    def commits(self) -> DataFrame:
        """(generation, run, identity, rows): one row for each run that ended well."""
        schema = "generation long, run string, identity string, rows long"
        path = f"{self.root}/commit"
        return self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def last(self) -> tuple[int, str | None]:
        """The last committed generation, 0 if there is none, and its identity."""
        row = self.commits().agg(F.max(F.struct("generation", "identity")).alias("c")).first()
        return (row["c"]["generation"], row["c"]["identity"]) if row["c"] else (0, None)

    def read(self, name: str) -> DataFrame:
        """A table as the last commit left it."""
        last, _ = self.last()
        if not last:
            raise ValueError(f"nothing is committed under {self.root}")
        touched = self.spark.read.parquet(f"{self.root}/touched").where(F.col("generation") <= last)
        newest = touched.groupBy("file").agg(F.max(F.struct("generation", "deleted")).alias("t")).where("NOT t.deleted").select("file", F.col("t.generation").alias("generation"))
        return self.spark.read.parquet(f"{self.root}/table={name}").join(newest, ["file", "generation"]).drop("generation")

    def apply(self, run: str, identity: str, touched: DataFrame, tables: dict[str, DataFrame], before_commit: Callable[[], None] | None = None) -> int:
        """One run: `touched` (file, deleted) are gone or replaced by the rows that `tables` have for them.

        A run that is committed already changes nothing. An index of another identity (the embedder's, say) must be built anew,
        in another root. before_commit is called when all is written but the commit."""
        last, own = self.last()
        if own is not None and own != identity:
            raise ValueError(f"the index is of {own}, not of {identity}")
        if done := self.commits().where(F.col("run") == run).select("generation").first():
            return done["generation"]
        n = last + 1
        total = 0
        for name, rows in tables.items():
            path = f"{self.root}/table={name}/generation={n}"
            rows.join(touched.where("NOT deleted").select("file"), "file", "left_semi").write.mode("overwrite").parquet(path)
            rows_n = self.spark.read.parquet(path).count()
            total += rows_n
            self.listener({"run": run, "stage": name, "rows": rows_n})
        touched.select("file", "deleted").write.mode("overwrite").parquet(f"{self.root}/touched/generation={n}")
        if before_commit:
            before_commit()
        self.spark.createDataFrame([(n, run, identity, total)], "generation long, run string, identity string, rows long").coalesce(1).write.mode("append").parquet(f"{self.root}/commit")
        self.listener({"run": run, "stage": "commit", "rows": total})
        return n

    def put(self, key: str, value: str) -> None:
        """Sets a key's value; the last one set holds."""
        row = self.spark.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), F.current_timestamp().alias("at"))
        row.write.mode("append").parquet(f"{self.root}/kv")

    def get(self, key: str) -> str | None:
        path = f"{self.root}/kv"
        if not self._there(path):
            return None
        rows = self.spark.read.schema("key string, value string, at timestamp").parquet(path).where(F.col("key") == key)
        return rows.agg(F.max_by("value", "at").alias("v")).first()["v"]

    def compacted(self, root: str, names: list[str], run: str) -> Index:
        """The same tables in one generation under another root."""
        _, identity = self.last()
        new = Index(self.spark, root)
        tables = {name: self.read(name) for name in names}
        files = None
        for rows in tables.values():
            own = rows.select("file").distinct()
            files = own if files is None else files.unionByName(own).distinct()
        new.apply(run, identity, files.withColumn("deleted", F.lit(False)), tables)
        return new


class Bus:
    """Hands events on to whoever listens; one that doesn't keep up loses its oldest, and the others nothing."""

    def __init__(self, most: int = 256) -> None:
        self.most, self.queues = most, []

    def subscribe(self) -> deque:
        queue: deque = deque(maxlen=self.most)
        self.queues.append(queue)
        return queue

    def __call__(self, event: dict) -> None:
        for queue in self.queues:
            queue.append(event)


def recovery(committed: Column, resolved: Column, raw_edges: Column, files: Column) -> Column:
    """What a start must do for an index where nothing has changed: resolve again, build anew, or nothing."""
    return F.when(committed & resolved, "nothing").when(raw_edges > 0, "resolve").when(files > 0, "rebuild").otherwise("nothing")


def identity_key(provider: str, model: str, dimensions: int | None) -> str:
    return f"{provider}|{model}|{'native' if dimensions is None else dimensions}"


def content_stamp(count: Column, key: Column) -> Column:
    """A number of 64 bits, in decimal, that changes with the count of chunks and with the embedder's identity."""
    digest = F.sha2(key, 256)
    first = F.concat(*[F.substring(digest, 15 - 2 * k, 2) for k in range(8)])  # eight bytes, the last first
    hashed = F.conv(first, 16, 10).cast("decimal(38,0)")
    return ((count.cast("decimal(18,0)") * F.lit(STAMP_PRIME).cast("decimal(18,0)") + hashed) % F.lit(str(TWO_64)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")


def shard_states(shards: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(repo, state): what a search may use of each repo's shard (repo, stamp), given counts (repo, chunks) and the identity.

    none: the repo has no chunks; cold: it has no shard; mismatch: the shard is of other chunks or another embedder; warm."""
    both = counts.join(shards, "repo", "left")
    state = F.when(F.col("chunks") == 0, "none").when(F.col("stamp").isNull(), "cold").when(F.col("stamp") != content_stamp(F.col("chunks"), F.lit(key)), "mismatch").otherwise("warm")
    return both.select("repo", state.alias("state"))


def evicted(shards: DataFrame, cap: int) -> DataFrame:
    """Shards (repo, bytes, used_at, active) that stay: active ones always, then the last used while all fit the cap.

    One row a shard: a window over them is as small as their number."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("active"), F.desc("used_at"), "repo").rowsBetween(Window.unboundedPreceding, 0)
    return shards.withColumn("held_", F.sum("bytes").over(order)).where(F.col("active") | (F.col("held_") <= cap)).drop("held_")


def cached(texts: DataFrame, cache: DataFrame, identity: str, dim: int) -> DataFrame:
    """texts (content, ..) with digest, and vector where the cache (identity, digest, vector) has one of that identity.

    A cached vector of another length is as if it weren't there."""
    good = cache.where((F.col("identity") == identity) & (F.size("vector") == dim)).select("digest", "vector").dropDuplicates(["digest"])
    return texts.withColumn("digest", F.md5("content")).join(good, "digest", "left")


def stored(cache: DataFrame, fresh: DataFrame, identity: str, now: Column) -> DataFrame:
    """The cache (identity, digest, vector, used_at) with fresh vectors (digest, vector), the new before the old; empty ones are not kept."""
    new = fresh.where(F.size("vector") > 0).select(F.lit(identity).alias("identity"), "digest", "vector", now.alias("used_at")).dropDuplicates(["digest"])
    return new.unionByName(cache.join(new.select("identity", "digest"), ["identity", "digest"], "left_anti"))


def purged(cache: DataFrame, now: Column, seconds: int) -> DataFrame:
    """The cache without what was not used for so long."""
    return cache.where(F.unix_timestamp(now) - F.unix_timestamp("used_at") <= seconds)


def write_cache(cache: DataFrame, path: str) -> None:
    """As Parquet, by identity and by the digest's first two letters, so that a probe of few digests reads few files."""
    cache.withColumn("shard", F.substring("digest", 1, 2)).write.partitionBy("identity", "shard").parquet(path)
