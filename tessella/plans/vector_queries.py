"""Vector search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import vector
from tessella.plans.registry import query
from tessella.sources.tables import table

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(
    "vector_topk",
    f"""SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
        ORDER BY score DESC, vec_id LIMIT 20""",
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    probe = vectors.where("vec_id = 0").select(F.lit(0).alias("query_id"), "embedding")
    return vector.topk(vectors, probe, key="vec_id", k=20).select("vec_id", "score")


_PROBE = "(SELECT vec_id AS probe_id, embedding AS probe FROM embeddings WHERE vec_id < {n})"
_SCORED = "scored AS (SELECT e.vec_id, e.label, q.probe_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.probe::DOUBLE[]), 6) AS score FROM embeddings e, " + _PROBE + " q)"


def _probes(vectors: DataFrame, n: int) -> DataFrame:
    return vectors.where(F.col("vec_id") < n).select(F.col("vec_id").alias("probe_id"), "embedding")


@query("vector_topk_per_repo", f"WITH {_SCORED.format(n=1)} SELECT label, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INT AS rank FROM scored) WHERE rank <= 5")
def vector_topk_per_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector.best_of(vector.scored(vectors, _probes(vectors, 1)), ["label"], "vec_id", 5).select("label", "vec_id", "score", "rank")


@query(
    "vector_fanout_merge",
    f"""WITH {_SCORED.format(n=3)}, shard AS (SELECT *, row_number() OVER (PARTITION BY probe_id, label ORDER BY score DESC, vec_id) AS r FROM scored)
        SELECT probe_id, vec_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, vec_id)::INT AS rank FROM shard WHERE r <= 10) WHERE rank <= 10""",
)
def vector_fanout_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per shard the best ten, then the best ten of all: exact, as scores of shards compare."""
    vectors = table(spark, sf_dir, "embeddings")
    shards = vector.best_of(vector.scored(vectors, _probes(vectors, 3)), ["probe_id", "label"], "vec_id", 10).drop("rank")
    return vector.best_of(shards, ["probe_id"], "vec_id", 10).select("probe_id", "vec_id", "label", "score", "rank")


#: Every ninth vector comes from another model, of 32 dimensions, and every tenth is empty.
_MIXED = "mixed AS (SELECT label, vec_id, CASE WHEN vec_id % 10 = 0 THEN [] WHEN vec_id % 9 = 0 THEN embedding[1:32] ELSE embedding END AS embedding FROM embeddings)"


@query("vector_dim_guard", f"WITH {_MIXED} SELECT label, count(*) FILTER (WHERE len(embedding) = 64) AS kept, count(*) FILTER (WHERE len(embedding) NOT IN (0, 64)) AS skipped, count(*) FILTER (WHERE len(embedding) = 0) AS none FROM mixed GROUP BY label")
def vector_dim_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, v = F.col("vec_id"), F.col("embedding")
    mixed = table(spark, sf_dir, "embeddings").select("label", F.when(key % 10 == 0, F.slice(v, 1, 0)).when(key % 9 == 0, F.slice(v, 1, 32)).otherwise(v).alias("embedding"))
    kept = vector.of_dimension(mixed, 64).groupBy("label").agg(F.count("*").alias("kept"))
    every = mixed.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 0).alias("none"))
    kept_n = F.coalesce("kept", F.lit(0))
    return every.join(kept, "label", "left").select("label", kept_n.alias("kept"), (F.col("n") - kept_n - F.col("none")).alias("skipped"), "none")


@query("file_cosine_4k", f"WITH {_SCORED.format(n=1)} SELECT vec_id, score FROM scored WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 20")
def file_cosine_4k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file's vectors, four times as many as asked for, as a reranker's input."""
    vectors = table(spark, sf_dir, "embeddings")
    one_file = vector.scored(vectors.where("label = 3"), _probes(vectors, 1))
    return one_file.orderBy(F.desc("score"), "vec_id").limit(4 * 5).select("vec_id", "score")


_Q8 = "list_transform({v}, lambda x: greatest(least(round(x / sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y::DOUBLE))) * 127), 127), -127)::INT)"
_APPROX = f"""q8 AS (SELECT vec_id, {_Q8.format(v="embedding::DOUBLE[]")} AS q FROM embeddings),
    approx AS (SELECT e.vec_id, p.vec_id AS probe_id, list_sum(list_transform(list_zip(e.q, p.q), lambda z: (z[1] * z[2])::BIGINT))::DOUBLE / 16129.0 AS score FROM q8 e, q8 p WHERE p.vec_id < {{n}})"""


def _approximate(vectors: DataFrame, n: int) -> DataFrame:
    q = vectors.select("vec_id", vector.quantised(F.col("embedding")).alias("q"))
    probes = vector.stated(q.where(F.col("vec_id") < n).select(F.col("vec_id").alias("probe_id"), F.col("q").alias("p")))
    return q.join(probes).select("vec_id", "probe_id", vector.dot_quantised(F.col("q"), F.col("p")).alias("score"))


@query("quantized_topk", f"WITH {_APPROX.format(n=1)} SELECT vec_id, round(score, 6) AS score FROM approx ORDER BY score DESC, vec_id LIMIT 20")
def quantized_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _approximate(table(spark, sf_dir, "embeddings"), 1)
    return found.orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", F.round("score", 6).alias("score"))


_SPACED = _SCORED.replace("vec_id < {n}", "vec_id % 100 = 0"), _APPROX.replace("p.vec_id < {{n}}", "p.vec_id % 100 = 0").replace("p.vec_id < {n}", "p.vec_id % 100 = 0")


@query(
    "quantization_recall",
    f"""WITH {_SPACED[0]}, {_SPACED[1]},
        a AS (SELECT probe_id, vec_id, score, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE vec_id <> probe_id),
        b AS (SELECT probe_id, vec_id, score, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, vec_id) AS r FROM approx WHERE vec_id <> probe_id)
        SELECT probe_id, count(*) FILTER (a.r <= 10 AND b.r <= 10) / 10.0 AS recall_10, count(*) FILTER (b.r <= 30) / 30.0 AS recall_30,
            round(avg(abs(a.score - b.score)) FILTER (a.r <= 10), 6) AS drift_mean, round(max(abs(a.score - b.score)) FILTER (a.r <= 10), 6) AS drift_max
        FROM a JOIN b USING (probe_id, vec_id) WHERE a.r <= 30 GROUP BY probe_id""",
)
def quantization_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes over the whole table, each left out of its own lists."""
    vectors = table(spark, sf_dir, "embeddings")
    found = vector.recall(vectors, vectors.where("vec_id % 100 = 0"), 64)
    return found.select("probe_id", "recall_10", "recall_30", *[F.round(c, 6).alias(c) for c in ("drift_mean", "drift_max")])


@query(
    "masked_mean_pool",
    """WITH s AS (SELECT label, i - 1 AS dim, sum(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) WHERE vec_id % 3 <> 0 GROUP BY ALL)
       SELECT label, dim::INT AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM s""",
)
def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.pooled(table(spark, sf_dir, "embeddings"), "label", F.col("vec_id") % 3 != 0)
    return found.select("label", "dim", F.round("value", 6).alias("value"))
