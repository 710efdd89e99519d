"""The change feed: debounced batches, recompute schedules and event-time windows, on batch and streaming frames alike.

A feed has rows (repo, path, kind, ts). Batch and stream share each plan, so the batch form can be checked against SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What an event says about its file; other kinds are ignored.
KINDS = {"signup": "added", "purchase": "added", "click": "modified", "view": "modified", "error": "deleted"}
#: Files change in bursts; a batch closes after so much quiet, and a recompute starts after so much more.
QUIET, SETTLE, RUN = "3 seconds", 4, 30


def feed(events: DataFrame, repos: int = 16) -> DataFrame:
    """An event table or stream as a change feed."""
    kind = F.lit(None).cast("string")
    for event, name in KINDS.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    rows = events.select((F.col("user_id") % repos).alias("repo"), F.get_json_object("props", "$.k").alias("path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.where(F.col("kind").isNotNull() & F.col("path").isNotNull())


def debounced(changes: DataFrame, quiet: str = QUIET) -> DataFrame:
    """(repo, opened, closed, changes): bursts that so much quiet parts. A stream needs a watermark on ts."""
    burst = F.session_window("ts", quiet)
    out = changes.groupBy("repo", burst.alias("burst")).agg(F.count("*").alias("changes"))
    return out.select("repo", F.col("burst.start").alias("opened"), F.col("burst.end").alias("closed"), "changes")


def windowed(changes: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """(opened, kind, changes) by tumbling or sliding windows of event time."""
    out = changes.groupBy(F.window("ts", width, slide).alias("w"), "kind").agg(F.count("*").alias("changes"))
    return out.select(F.col("w.start").alias("opened"), "kind", "changes")


def _runs(settle: int, run: int):
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo = starts = floor = n = None
        rearmed = False
        for frame in frames:
            out = []
            for r, closed in zip(frame["repo"], frame["closed"]):
                if repo is not None and r == repo and closed < starts:  # the run has yet to start: it waits for this burst too
                    starts, n = max(floor, closed + settle), n + 1
                    continue
                if repo is not None:
                    out.append((repo, starts, rearmed, n))
                floor = starts + run if r == repo else closed
                repo, rearmed, n = r, r == repo and closed < floor, 1
                starts = max(floor, closed + settle)
            yield pd.DataFrame(out, columns=["repo", "starts", "rearmed", "bursts"])
        if repo is not None:
            yield pd.DataFrame([(repo, starts, rearmed, n)], columns=["repo", "starts", "rearmed", "bursts"])

    return fold


def recomputes(bursts: DataFrame, settle: int = SETTLE, run: int = RUN) -> DataFrame:
    """(repo, starts, rearmed, bursts): the runs that take the bursts up, and how many each does.

    A run waits for so many quiet seconds after the last burst, and for the run before, which takes so many seconds. Bursts
    that close while a run is under way make one trailing run, which takes them all. One run of a repo at a time. Each
    repo's bursts stream by in order, and no more than the run that is to come is held."""
    rows = bursts.select(F.col("repo").cast("long").alias("repo"), F.unix_micros("closed").alias("closed"))
    return rows.repartition("repo").sortWithinPartitions("repo", "closed").mapInPandas(_runs(settle * 1_000_000, run * 1_000_000), "repo long, starts long, rearmed boolean, bursts long")


def latest(changes: DataFrame) -> DataFrame:
    """(repo, path, kind, ts): of each path its last change; what a batch of a feed comes down to."""
    order: Column = F.struct("ts", "kind")
    return changes.groupBy("repo", "path").agg(F.max(order).alias("last")).select("repo", "path", "last.kind", "last.ts")


def stream(spark: SparkSession, folder: str, schema: str, late: str = "1 hour", files: int = 64) -> DataFrame:
    """A folder of Parquet event files as a change feed; so many files a trigger hold a fast source back."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return feed(source).withWatermark("ts", late)


def maintain(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Runs `apply` on each batch's last changes, one batch at a time. apply must give the same result if a batch is replayed
    with its number, as it is after a crash."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: apply(latest(batch), n))
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": every})).start()


def poll(spark: SparkSession, update: Callable[[str], object], checkpoint: str, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Calls `update` with a name for each batch, again and again, one at a time: what a watcher missed is found by the next full
    look. update must do nothing new for a name that it has had."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: update(f"poll-{n}"))
    return writer.trigger(**({"once": True} if once else {"processingTime": every})).start()


def progress(query: StreamingQuery) -> list[tuple[int, int, int]]:
    """(batch, rows, milliseconds) of a stream's last batches."""
    return [(p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution", 0)) for p in query.recentProgress]
