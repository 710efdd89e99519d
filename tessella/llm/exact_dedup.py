"""Exact deduplication by a cuckoo-filter index of live digests.

Texts are equal when identical after lower-casing A-Z. Each is digested once (SHA-256 of the UTF-8 bytes); equal digests
are combined where they are read, so a group of any size sends one row a batch; the digests are then dealt by value, and
each task keeps the live ones of its share in a cuckoo-filter index: a digest that the filter doesn't know is inserted, a hit
is verified against the bucketed content, and a row that supersedes the one that stays so far deletes its entry and inserts
its own. As many tasks share the digests as keep each one's index within SHARE.

Defined cases: null text counts as empty; of equal texts the row with the largest key stays, null being below all others;
of rows that repeat that key exactly one stays; an empty table gives no rows; further columns are not looked at; a very long
text is held once, by the task that digests it, and only its digest travels.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm._arrow import pieces, strings
from tessella.llm.cuckoo import CuckooIndex
from tessella.llm.storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
NONE = -(2**63)
#: Groups that a task hands on at once.
OUT_ROWS = 20_000
#: Rows whose digests a task's index gets at most, about 100 bytes each.
SHARE = 1 << 20
_TAG = "tessella_digest_"


def _digest(text: memoryview, null: bool) -> bytes:
    return hashlib.sha256(b"" if null else bytes(text).translate(ASCII_LOWER)).digest()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 4096, 8 << 20):
        data, at, nulls = strings(batch.column(1))
        digests = [_digest(data[a:b], n) for a, b, n in zip(at, at[1:], nulls)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.binary())], ["doc_id", "uid", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, a number that no other row has, and the digest of the normalised text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("uid"))
    return own.mapInArrow(_digested, "doc_id long, uid long, digest binary")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of a batch: how many rows have it, and the largest (doc_id, uid)."""
    for batch in batches:
        ids = batch.column(0).fill_null(NONE).to_numpy(zero_copy_only=False)
        uids = batch.column(1).to_numpy(zero_copy_only=False)
        order = np.lexsort((uids, ids))[::-1]
        table = pa.table({"digest": batch.column(2).take(pa.array(order)), "id": ids[order], "uid": uids[order]})
        out = table.group_by("digest", use_threads=False).aggregate([("id", "first"), ("uid", "first"), ("id", "count")])
        yield from out.select(["digest", "id_first", "uid_first", "id_count"]).combine_chunks().rename_columns(["digest", "keep_id", "keep_uid", "group_size"]).to_batches()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of one task, folded into the index of those that are live: (row that stays, how many rows)."""
    index = CuckooIndex()
    for batch in batches:
        for digest, keep, uid, n in zip(*(c.to_pylist() for c in batch.columns)):
            slot = index.find(digest)
            if slot < 0:
                index.insert(digest, (keep, uid, n))
                continue
            stays, stays_uid, rows = index.get(slot)
            if (keep, uid) > (stays, stays_uid):
                index.delete(digest)
                index.insert(digest, (keep, uid, rows + n))
            else:
                index.put(slot, (stays, stays_uid, rows + n))
    found, part = index.items(), []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), *(pa.array([v[i] for _, v in part], pa.int64()) for i in range(3))], ["digest", "keep_id", "keep_uid", "group_size"])

    for pair in found:
        part.append(pair)
        if len(part) == OUT_ROWS:
            yield out()
            part = []
    yield out()


_GROUPS = "digest binary, keep_id long, keep_uid long, group_size long"


def groups(digested: DataFrame) -> DataFrame:
    """One row for each digest: its rows' number, and the row that stays. digested: a written table, to be read twice."""
    tasks = max(int(digested.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(digested.count() / SHARE))
    return digested.mapInArrow(_combined, _GROUPS).repartition(tasks, "digest").mapInArrow(_folded, _GROUPS)


def _decided(digested: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept of each digested row."""
    return digested.join(groups(digested), "digest").select(
        "doc_id", "digest", F.when(F.col("keep_id") != NONE, F.col("keep_id")).alias("keep_id"), "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept")
    )


def dedup(docs: DataFrame) -> DataFrame:
    """Each row's decision: keep_id, group_size, kept and the digest in lower-case hex."""
    return _decided(written(digests(docs), "digests")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 4096, 8 << 20):
        data, at, nulls = strings(batch.column(batch.schema.get_field_index("text")))
        tags = [_digest(data[a:b], n) for a, b, n in zip(at, at[1:], nulls)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags, pa.binary())], [*batch.schema.names, _TAG])


def survivors(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that stay: one row of each group of equal texts, even where rows repeat.

    Where no two rows have the same doc_id, it alone tells what stays. Only rows whose doc_id repeats are digested again, to
    be told apart by text, and of those that repeat in full the first is taken."""
    digested = written(digests(docs), "digests")
    kept = written(_decided(digested).where("kept").select(F.col("doc_id").alias("tessella_id_"), F.col("digest").alias("tessella_tag_")), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("tessella_id_"))
    repeated = digested.groupBy(F.col("doc_id").alias("tessella_id_")).agg(F.count("*").alias("n")).where("n > 1").select("tessella_id_")
    if repeated.isEmpty():
        return docs.join(kept.select("tessella_id_"), same, "left_semi")
    repeated = written(repeated, "repeated")
    again = repeated.withColumnRenamed("tessella_id_", "again_")
    once = kept.join(again, F.col("tessella_id_").eqNullSafe(F.col("again_")), "left_anti").select("tessella_id_")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    tagged = docs.join(repeated, same, "left_semi").mapInArrow(_tagged, f"{kinds}, {_TAG} binary")
    told = tagged.join(kept, (F.col(_TAG) == F.col("tessella_tag_")) & same, "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", _TAG).orderBy(F.lit(0)))
    told = told.withColumn("tessella_nth_", nth).where("tessella_nth_ = 1").select(*docs.columns)
    return docs.join(once, same, "left_semi").unionByName(told)


def op7_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_cuckoo_exact_dedup": op7_cuckoo_exact_dedup}
_NORMAL = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SQL = {
    "op7_cuckoo_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""
}
