"""Exact vector search on arrays of floats, in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that are compared at once with a block of probes, probes of a block, and blocks whose lists a task holds.
CHUNK, BLOCK, HELD = 4096, 256, 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length or without direction."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (scale == 0), F.lit(0.0)).otherwise(dot(a, b) / scale)


def _near(probe: np.ndarray, k: int, at: int):
    """Batches of rows with their cosine with the probe, of each batch those that may be among the k best."""
    length = np.linalg.norm(probe)
    unit = probe / length if length > 0 else probe

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(at).is_valid())
            n = batch.num_rows
            if not n:
                continue
            own = batch.column(at)
            sizes, flat = np.asarray(own.value_lengths()), own.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            same = sizes == len(probe)
            rows = flat.reshape(n, -1) if same.all() else flat[np.repeat(same, sizes)].reshape(same.sum(), len(probe))
            norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
            scores = np.zeros(n)
            scores[same] = np.round(np.divide(rows @ unit, norms, out=np.zeros(len(rows)), where=norms > 0), 6)
            keep = np.flatnonzero(scores >= np.partition(scores, n - k)[n - k]) if n > k else np.arange(n)
            others = [batch.column(c).take(pa.array(keep)) for c in range(batch.num_columns) if c != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(scores[keep])], [*(x for c, x in enumerate(batch.schema.names) if c != at), "score"])

    return run


def topk(vectors: DataFrame, probe: DataFrame, key: str, k: int) -> DataFrame:
    """The k nearest rows to a probe of one row, ties by key, with score; vectors of another length or without direction have 0.

    Batches are multiplied as matrices, and each hands on its own k best, so what is put in order grows with the batches."""
    one = probe.select("embedding").first()
    if one is None or one["embedding"] is None:
        return vectors.limit(0).withColumn("score", F.lit(0.0)).drop("embedding")
    q = np.array(one["embedding"], dtype=np.float64)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "embedding")
    return vectors.mapInArrow(_near(q, k, vectors.columns.index("embedding")), f"{kinds}, score double").orderBy(F.desc("score"), key).limit(k)


#: Probes that are sent to all tasks.
PROBES = 4096


def stated(probes: DataFrame) -> DataFrame:
    """A query set that is sent to all tasks; an error if it has more than PROBES rows, for which `recall` compares in blocks."""
    if probes.limit(PROBES + 1).count() > PROBES:
        raise ValueError(f"more than {PROBES} probes")
    return F.broadcast(probes)


def scored(vectors: DataFrame, probes: DataFrame) -> DataFrame:
    """Each vector against each probe of a stated set of PROBES at most: columns of vectors, probe_id, score."""
    q = stated(probes.select("probe_id", F.col("embedding").alias("probe")))
    return vectors.where(F.col("embedding").isNotNull()).join(q).withColumn("score", F.round(cosine(F.col("embedding"), F.col("probe")), 6)).drop("embedding", "probe")


def best_of(scores: DataFrame, groups: list[str], key: str, k: int) -> DataFrame:
    """The k best rows of each group, numbered from 1, ties by key."""
    nth = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("score"), key))
    return scores.withColumn("rank", nth).where(F.col("rank") <= k)


def of_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    """Only vectors of the index's dimension."""
    return vectors.where(F.size("embedding") == dim)


def quantised(v: Column) -> Column:
    """The unit vector in steps of 1/127, as integers."""
    return F.transform(l2_normalised(v), lambda x: F.greatest(F.least(F.round(x * 127), F.lit(127.0)), F.lit(-127.0)).cast("int"))


def dot_quantised(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x) / (127.0 * 127.0)


def pooled(vectors: DataFrame, group: str, mask: Column) -> DataFrame:
    """(group, dim, value): the masked sum of each group's vectors, as a unit vector."""
    flat = vectors.where(mask).select(group, F.posexplode("embedding").alias("dim", "x"))
    sums = flat.groupBy(group, "dim").agg(F.sum(F.col("x").cast("double")).alias("value"))
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(group)))
    return sums.select(group, "dim", F.when(length > 0, F.col("value") / length).otherwise(F.col("value")).alias("value"))


def _packed(rows: int, dim: int):
    def run(batches):
        ids, parts, n = [], [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["ids", "m"])
        for batch in batches:
            own, m = batch.column(0).to_numpy().astype(np.int64), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            for at in range(0, len(own), rows):
                if n + len(own[at : at + rows]) > rows:
                    yield pack()
                    ids, parts, n = [], [], 0
                ids.append(own[at : at + rows])
                parts.append(m[at : at + rows])
                n += len(ids[-1])
        if n:
            yield pack()

    return run


def _both(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows as unit vectors, and quantised."""
    m = m.astype(np.float64)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    m = np.divide(m, n, out=m, where=n > 0)
    q = np.clip(np.sign(m) * np.floor(np.abs(m) * 127 + 0.5), -127, 127)
    return m, q


def _first(ids: np.ndarray, by: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties by id."""
    at = np.arange(len(by))
    if len(by) > k:
        at = np.flatnonzero(by >= np.partition(by, len(by) - k)[len(by) - k])
    return at[np.lexsort((ids[at], -by[at]))[:k]]


def _nearest(k: int, dim: int):
    """From rows (p_ids, p_m, ids, m): each probe's k best by each of two scores, of what the task has seen."""

    def run(batches):
        held: dict[bytes, tuple] = {}

        def out():
            for key, (lists, _, _) in held.items():
                for probe, kinds in zip(np.frombuffer(key, np.int64).tolist(), lists):
                    for kind, (i, e, a) in enumerate(kinds):
                        yield pa.RecordBatch.from_arrays([pa.array([probe] * len(i), pa.int64()), pa.array([kind] * len(i), pa.int32()), pa.array(i), pa.array(e), pa.array(a)], ["probe_id", "kind", "vec_id", "exact", "near"])

        for batch in batches:
            for p_ids, p_m, ids, m in zip(*(c.to_pylist() for c in batch.columns)):
                if p_ids not in held:
                    if len(held) >= HELD:
                        yield from out()
                        held.clear()
                    none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
                    held[p_ids] = ([[none, none] for _ in range(len(p_ids) // 8)], *_both(np.frombuffer(p_m, np.float32).reshape(-1, dim)))
                lists, unit, q = held[p_ids]
                ids = np.frombuffer(ids, np.int64)
                v, w = _both(np.frombuffer(m, np.float32).reshape(-1, dim))
                exact, near = np.round(unit @ v.T, 6), q @ w.T / 16129.0
                for j, probe in enumerate(np.frombuffer(p_ids, np.int64).tolist()):
                    other = np.flatnonzero(ids != probe)
                    i, both = ids[other], (exact[j, other], near[j, other])
                    for kind in (0, 1):
                        at = _first(i, both[kind], k)
                        every = [np.concatenate([x, y]) for x, y in zip(lists[j][kind], (i[at], both[0][at], both[1][at]))]
                        at = _first(every[0], every[1 + kind], k)
                        lists[j][kind] = tuple(x[at] for x in every)
        yield from out()

    return run


def recall(vectors: DataFrame, probes: DataFrame, dim: int) -> DataFrame:
    """(probe_id, recall_10, recall_30, drift_mean, drift_max) of quantised against exact search over vectors (vec_id, embedding),
    for each probe without itself. Drift is the scores' difference over the exact ten. Each probe meets each vector, in blocks."""
    pack = lambda df, n: of_dimension(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), dim).mapInArrow(_packed(n, dim), "ids binary, m binary")
    pairs = pack(probes, BLOCK).toDF("p_ids", "p_m").crossJoin(pack(vectors, CHUNK))
    found = pairs.mapInArrow(_nearest(30, dim), "probe_id long, kind int, vec_id long, exact double, near double")
    by = Window.partitionBy("probe_id", "kind").orderBy(F.desc(F.when(F.col("kind") == 0, F.col("exact")).otherwise(F.col("near"))), "vec_id")
    found = found.withColumn("r", F.row_number().over(by)).where("r <= 30")
    best = found.groupBy("probe_id", "vec_id").agg(*[F.min(F.when(F.col("kind") == n, F.col("r"))).alias(c) for n, c in ((0, "a"), (1, "b"))], F.max(F.abs(F.col("exact") - F.col("near"))).alias("drift"))
    hits = [(F.count_if((F.col("a") <= k) & (F.col("b") <= k)) / F.count_if(F.col("a") <= k)).alias(f"recall_{k}") for k in (10, 30)]
    ten = F.when(F.col("a") <= 10, F.col("drift"))
    return best.groupBy("probe_id").agg(*hits, F.avg(ten).alias("drift_mean"), F.max(ten).alias("drift_max"))


#: Texts and bytes of one batch for an embedder.
BATCH_TEXTS, BATCH_BYTES = 128, 1_500_000


def batches(texts: DataFrame, group: str, order: list[str], rows: int = BATCH_TEXTS, size: int = BATCH_BYTES) -> DataFrame:
    """texts (group, bytes, ..) with batch, numbered from 0 within each group: in order, at most so many rows and bytes; a
    larger text travels alone. A group's rows stream by, so no group is held."""

    def run(pdfs):
        own = batch = n = total = None
        for pdf in pdfs:
            out = []
            for g, b in zip(pdf[group], pdf["bytes"]):
                if g != own:
                    own, batch, n, total = g, 0, 0, 0
                elif n and (n >= rows or total + b > size):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + b
                out.append(batch)
            yield pdf.assign(batch=out)

    source = texts.where(F.col(group).isNotNull()).repartition(group).sortWithinPartitions(group, *order)
    return source.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", batch long")


def _bytes(batches):
    for batch in batches:
        values = [None if v is None else np.asarray(v, "<f4").tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], ["vec_id", "packed"])


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, packed): each vector's floats as little-endian bytes of four."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_bytes, "vec_id long, packed binary")


def _floats(batches):
    for batch in batches:
        values = [None if b is None or len(b) % 4 else np.frombuffer(b, "<f4") for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float32()))], ["vec_id", "embedding"])


def unpacked(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) from packed bytes; bytes that aren't whole floats give null."""
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "packed").mapInArrow(_floats, "vec_id long, embedding array<float>")


def without(vectors: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
    """Vectors but for those of files or repos that are gone."""
    return vectors.join(gone.select(*by).distinct(), by, "left_anti")


def replaced(vectors: DataFrame, fresh: DataFrame, touched: DataFrame, dim: int, by: list[str]) -> DataFrame:
    """An increment: what belongs to the touched files goes, and their fresh vectors of the index's dimension come."""
    return without(vectors, touched, by).unionByName(of_dimension(fresh, dim))
