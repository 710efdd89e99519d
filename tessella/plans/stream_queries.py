"""Queries over the change feed, in their batch form, and over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.registry import query
from tessella.sources.tables import table
from tessella.streaming import changes

#: The events are sparse: minutes stand for the watcher's seconds.
_QUIET, _SETTLE, _RUN = 180, 240, 1800
_FEED = """feed AS (SELECT user_id % 16 AS repo, json_extract_string(props, '$.k') AS path, epoch_us(ts) AS us,
    CASE event_type WHEN 'signup' THEN 'added' WHEN 'purchase' THEN 'added' WHEN 'click' THEN 'modified' WHEN 'view' THEN 'modified' WHEN 'error' THEN 'deleted' END AS kind FROM events),
    f AS (SELECT * FROM feed WHERE kind IS NOT NULL AND path IS NOT NULL)"""
_BURST = f"""a AS (SELECT repo, us, CASE WHEN us < lag(us) OVER (PARTITION BY repo ORDER BY us) + {_QUIET}000000 THEN 0 ELSE 1 END AS new FROM f),
    b AS (SELECT repo, us, sum(new) OVER (PARTITION BY repo ORDER BY us ROWS UNBOUNDED PRECEDING) AS n FROM a),
    burst AS (SELECT repo, min(us) AS opened, max(us) + {_QUIET}000000 AS closed, count(*) AS changes FROM b GROUP BY repo, n)"""


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return changes.feed(table(spark, d, "events"))


@query("debounce_sessions", f"WITH {_FEED}, {_BURST} SELECT repo, opened, closed, changes FROM burst")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bursts = changes.debounced(_feed(spark, sf_dir), f"{_QUIET} seconds")
    return bursts.select("repo", F.unix_micros("opened").alias("opened"), F.unix_micros("closed").alias("closed"), "changes")


_PENDING = "b.closed < r.starts"


@query(
    "recompute_schedule",
    f"""WITH RECURSIVE {_FEED}, {_BURST.replace("b AS", "c AS", 1).replace("FROM b GROUP", "FROM c GROUP")}, b AS (SELECT repo, closed, row_number() OVER (PARTITION BY repo ORDER BY closed) AS k FROM burst),
        r AS (SELECT repo, k, 1 AS run, closed + {_SETTLE}000000 AS starts, closed AS floor, false AS rearmed FROM b WHERE k = 1
              UNION ALL SELECT b.repo, b.k, CASE WHEN {_PENDING} THEN r.run ELSE r.run + 1 END, greatest(CASE WHEN {_PENDING} THEN r.floor ELSE r.starts + {_RUN}000000 END, b.closed + {_SETTLE}000000),
                CASE WHEN {_PENDING} THEN r.floor ELSE r.starts + {_RUN}000000 END, CASE WHEN {_PENDING} THEN r.rearmed ELSE b.closed < r.starts + {_RUN}000000 END FROM r JOIN b ON b.repo = r.repo AND b.k = r.k + 1)
        SELECT repo, max(starts) AS starts, bool_or(rearmed) AS rearmed, count(*) AS bursts FROM r GROUP BY repo, run""",
)
def recompute_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.recomputes(changes.debounced(_feed(spark, sf_dir), f"{_QUIET} seconds"), _SETTLE, _RUN)


@query("tumbling_changes", f"WITH {_FEED} SELECT us // 3600000000 * 3600 AS opened, kind, count(*) AS changes FROM f GROUP BY ALL")
def tumbling_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.windowed(_feed(spark, sf_dir), "1 hour").select(F.unix_timestamp("opened").alias("opened"), "kind", "changes")


@query("sliding_changes", f"WITH {_FEED} SELECT (us // 1800000000 - k) * 1800 AS opened, kind, count(*) AS changes FROM f, range(2) t(k) GROUP BY ALL")
def sliding_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.windowed(_feed(spark, sf_dir), "1 hour", "30 minutes").select(F.unix_timestamp("opened").alias("opened"), "kind", "changes")


@query("latest_changes", f"WITH {_FEED} SELECT repo, path, arg_max(kind, (us, kind)) AS kind, max(us) AS at FROM f GROUP BY ALL")
def latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest(_feed(spark, sf_dir)).select("repo", "path", "kind", F.unix_micros("ts").alias("at"))


#: Turns of a conversation that are kept, and turns with context, with their caps in characters.
HISTORY, CONTEXT, TURN_CHARS, ALL_CHARS = 40, 3, 1500, 3000
_TURNS = "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


@query("history_window", f"WITH {_TURNS} SELECT conv_id, turn, role, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM t) WHERE r <= {HISTORY}")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    turns = _turns(spark, sf_dir).withColumn("r", F.row_number().over(newest)).where(F.col("r") <= HISTORY)
    return turns.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query(
    "tool_context_cap",
    f"""WITH {_TURNS}, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS r FROM t WHERE role = 'assistant' AND trim(text) <> ''),
        k AS (SELECT conv_id, turn, r, left(text, {TURN_CHARS}) AS text FROM c WHERE r <= {CONTEXT}),
        s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS used FROM k)
        SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY r DESC))::INT AS place, left(text, greatest({ALL_CHARS} - used, 0)) AS text FROM s""",
)
def tool_context_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns that have context, oldest first, each and all of them cut to size; older ones are cut first."""
    own = Window.partitionBy("conv_id")
    said = _turns(spark, sf_dir).where((F.col("role") == "assistant") & (F.trim("text") != ""))
    kept = said.withColumn("r", F.row_number().over(own.orderBy(F.desc("turn"), "text"))).where(F.col("r") <= CONTEXT).withColumn("text", F.substring("text", 1, TURN_CHARS))
    used = F.coalesce(F.sum(F.length("text")).over(own.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.substring(F.col("text"), F.lit(1), F.greatest(ALL_CHARS - F.col("used"), F.lit(0)).cast("int"))
    return kept.withColumn("used", used).select("conv_id", "turn", F.row_number().over(own.orderBy(F.desc("r"))).alias("place"), cut.alias("text"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
