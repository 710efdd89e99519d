"""Best-fit packing of token sequences, in a hierarchy of residual rounds.

A document's ids and an end id form one item, or, if longer than a sequence, full pieces after a shorter first one. Each
task packs its own items best-fit decreasing and settles bins that are nearly full. Underfull bins go on as items of their
own to ever fewer tasks and are packed again, until one task's worth is left or a round saves less than `saving` of its bins
(0: none at all). Only lengths travel; a task gets at most a bounded number of items, whatever the input's size.

Defined cases: null text is empty, hence one piece of the end id; rows that repeat an id are packed each; an empty table
gives no rows; a very long text is encoded in parts, and its ids are held once; further columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import tokens
from tessella.llm._arrow import pieces
from tessella.llm.storage import written

SEQUENCE = 2048
#: A bin with no more room than this is settled.
SLACK = 4
#: Items that a task packs at once, and those that a task of the later rounds is meant to get.
BLOCK, SHARE = 1 << 17, 1 << 14
FAN_IN = 8
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"


def best_fit(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Each item's bin and offset, and each bin's fill: longest first, into the fullest bin that has room."""
    bins, at, fill = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), []
    room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0  # bit r: a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := open_rooms >> n:
            r = (fits & -fits).bit_length() - 1 + n
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = size, len(fill)
            fill.append(0)
        bins[i], at[i] = b, fill[b]
        fill[b] += n
        if r > n:
            if not room[r - n]:
                open_rooms |= 1 << (r - n)
            room[r - n].append(b)
    return bins, at, fill


def _tokenised(size: int, end: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_bin: int | None = None  # from the first row's number, which no other partition has
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal next_bin
            lengths = np.array([r[3] for r in rows], dtype=np.int64)
            bins, at, fill = best_fit(lengths, size)
            out = [pa.array(c) for c in zip(*rows)] + [pa.array(bins + next_bin), pa.array(at), pa.array(np.array(fill)[bins])]
            next_bin += len(fill)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "fill"]
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(out, kinds)], names)

        for batch in pieces(batches, 1024, 4 << 20):
            if next_bin is None and batch.num_rows:
                next_bin = batch.column(2)[0].as_py()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(tokens.ids(text or "", path), np.uint32(end)).astype("<u4")
                start, cut = 0, len(ids) % size or size
                for k in range(math.ceil(len(ids) / size)):
                    part = ids[start : start + cut]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
                    start, cut = start + len(part), size
                if len(rows) >= BLOCK:
                    yield packed()
                    rows.clear()
        if rows:
            yield packed()

    return run


def _merged(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fills = [], []

        def packed() -> pa.RecordBatch:
            order = np.argsort(np.concatenate(ids), kind="stable")
            own, filled = np.concatenate(ids)[order], np.concatenate(fills)[order]
            bins, at, fill = best_fit(filled, size)
            first = np.zeros(len(fill), dtype=np.int64)
            first[bins[at == 0]] = own[at == 0]
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(first[bins]), pa.array(at), pa.array(np.array(fill)[bins])], ["bin", "root", "base", "fill"])

        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            fills.append(batch.column(1).to_numpy())
            if sum(map(len, ids)) >= BLOCK:
                yield packed()
                ids.clear()
                fills.clear()
        if ids:
            yield packed()

    return run


def pack(docs: DataFrame, size: int = SEQUENCE, end: int = 0, path: str = tokens.RANKS, saving: float = 0.05) -> DataFrame:
    """The pieces of every document, with the sequence and the offset in it that each is given."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    placed = written(source.mapInArrow(_tokenised(size, end, path), _PIECES), "pieces")
    left = placed.where((F.col("at") == 0) & (F.col("fill") < size - SLACK)).select("bin", "fill")
    n, parts, moved = left.count(), 0, None
    while n > 1:
        parts = max(1, math.ceil(n / SHARE), math.ceil(parts / FAN_IN))
        step = written(left.repartition(parts, "bin").mapInArrow(_merged(size), "bin long, root long, base long, fill long"), "bins")
        if moved is None:
            moved = step.select("bin", "root", "base")
        else:
            after = step.select(F.col("bin").alias("root"), F.col("root").alias("root2"), F.col("base").alias("base2"))
            moved = moved.join(after, "root", "left").select("bin", F.coalesce("root2", "root").alias("root"), (F.col("base") + F.coalesce("base2", F.lit(0))).alias("base"))
        left = step.where((F.col("base") == 0) & (F.col("fill") < size - SLACK)).select(F.col("root").alias("bin"), "fill")
        before, n = n, left.count()
        if parts == 1 or n == before or n > (1 - saving) * before:
            break
    if moved is not None:
        placed = placed.join(moved, "bin", "left")
    else:
        placed = placed.withColumns({"root": F.col("bin"), "base": F.lit(0)})
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("root", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("base", F.lit(0))).cast("long").alias("offset")
    )


def op9_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_residual_packing": op9_residual_packing}
