"""Sharding by weighted rendezvous hashing, in built-in functions only.

Each record key scores every shard with an independent hash u in (0, 1); the shard with the least -ln(u) / weight owns it.
A shard that joins only competes for itself, so it takes rows from all others and moves none between them; a shard's
expected share is its weight over the sum of weights.

Defined cases: a null key hashes as the text 'null'; rows that repeat a key share its shard, with slots of their own; a
null text has no bytes, so size 16 and CRC 0; an empty table gives no rows; a very long text counts with all its bytes. Input columns whose names clash with the
output's are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.prefix import bucket_offsets
from tessella.llm.storage import written

#: 2^31 - 1: a product of two numbers below it fits in a long.
PRIME = 2_147_483_647
#: Slots are numbered within these many hash ranges of a shard, then joined: a shard's rows never meet in one task.
RANGES = 1024
SHARDS = 40
#: Every fifth node has twice the room.
WEIGHTS = tuple(2.0 if s % 5 == 0 else 1.0 for s in range(SHARDS + 1))


def _halves(key: Column) -> tuple[Column, Column]:
    """Two numbers of 30 bits from the MD5 of a key."""
    hexed = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    part = lambda a: F.conv(F.substring(hexed, a, 8), 16, 10).cast("long").bitwiseAND(0x3FFFFFFF)
    return part(1), part(9)


def _draw(lo: Column, hi: Column, shard: Column) -> Column:
    """Uniform in (0, 1), from key and shard: rounds of multiplication modulo a prime with folds between."""
    x = ((lo + (shard + 1) * 7_919_173) % PRIME * 48_271) % PRIME
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = ((x + hi) % PRIME * 69_621) % PRIME
    x = x.bitwiseXOR(F.shiftright(x, 13))
    x = ((x + (shard + 1) * 104_729) % PRIME * 1_583_458_089) % PRIME
    return (x + 0.5) / 2_147_483_648.0


def owners(rows: DataFrame, key: str, weights: tuple[float, ...], more: tuple[float, ...] = ()) -> DataFrame:
    """rows with shard (among weights) and grown_shard (among weights and more); ties go to the smaller number."""
    lo, hi = _halves(F.col(key))
    scored = rows.withColumns({"lo_": lo, "hi_": hi})

    def best(first: int, ws: tuple[float, ...]) -> Column:
        pairs = F.arrays_zip(F.lit(list(range(first, first + len(ws)))).alias("s"), F.lit(list(ws)).alias("w"))
        return F.array_min(
            F.transform(pairs, lambda p: F.struct((-F.ln(_draw(F.col("lo_"), F.col("hi_"), p["s"].cast("long"))) / p["w"]).alias("cost"), p["s"].cast("int").alias("s")))
        )

    scored = scored.withColumn("own_", best(0, weights))
    grown = F.least(F.col("own_"), best(len(weights), more)) if more else F.col("own_")
    return scored.withColumns({"shard": F.col("own_.s"), "grown_shard": grown["s"]}).drop("own_")


def shard(docs: DataFrame, weights: tuple[float, ...], more: tuple[float, ...] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, size, CRC, shard, slot within the shard from 0, and shard after more shards have joined."""
    crc = F.coalesce(F.crc32(F.encode(F.col(text), "UTF-8")), F.lit(0)).cast("long")
    rows = docs.select(F.col(key), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"), crc.alias("text_crc32"))
    # owners are found once; what is read again is some 50 bytes a row
    placed = written(owners(rows, key, weights, more).withColumn("range_", F.shiftright("hi_", 20)), "owners")
    # at most shards x RANGES rows
    offsets = F.broadcast(bucket_offsets(placed, ["shard"], "range_", F.lit(1)))
    within = Window.partitionBy("shard", "range_").orderBy("hi_", "lo_", key, "text_crc32")
    return (
        placed.withColumn("at_", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "range_"])
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset_") + F.col("at_")).cast("long").alias("slot"), "grown_shard")
    )


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs, WEIGHTS[:SHARDS], WEIGHTS[SHARDS:])


QUERIES = {"op1_rendezvous_sharding": op1_rendezvous_sharding}
