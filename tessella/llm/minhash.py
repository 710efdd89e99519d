"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

1. Each text becomes a set of word shingles, 128 minima, 32 band keys of four minima, and a signature that keeps the low
   four bits of each minimum. Equal sets are one class from here on, whatever their number.
2. Classes that share a band key are compared by counting equal fields of their packed signatures; the count is corrected
   for fields that agree by chance. Pairs whose estimate is within five standard deviations of the threshold, or above,
   join a cluster. A band key of very many classes joins them all to one cluster, without comparing.
3. Within clusters, links are confirmed on full sets, by counting common shingles over an inverted index, in blocks of
   bounded size. First each block meets itself and a few pivots of its cluster; in a group of near copies that joins
   nearly all. Only what is left outside of the cluster's largest component then meets those of the cluster that share a
   band with it, in blocks, as no link inside of that component can tell anything. A block sends back a spanning forest of
   its links.
4. Components of the links are the groups; each is named by its smallest doc_id.

A pair at the threshold shares no band with probability (1 - 0.8^4)^32 = 5e-8, and less above it.

Defined cases: texts without words, and nulls, have an empty set and are linked with nothing; a null doc_id counts as the
smallest; rows that repeat a doc_id are one document with the links of all its texts; an empty table gives no rows;
further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._arrow import pieces, strings
from tessella.llm.components import BLOCK, Forest, components
from tessella.llm.storage import written
from tessella.llm.words import mix, shingles, word_hashes

BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
#: Standard deviations of the estimate below the threshold at which a pair is no longer confirmed on full sets.
MARGIN = 5.0
#: Band keys of more classes than this are not compared pair by pair.
BUCKET = 2048
#: Of a block of a cluster: classes, and shingles of all of them.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19
#: Blocks of a cluster of which each sends one class, its first, to all others.
PIVOTS = 8
NONE = -(2**63)
_rng = np.random.default_rng(77_003)
_A = (_rng.integers(0, 2**31, MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)
_C = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_SIGNED = "doc_id long, n_shingles long, class binary, signature binary, bands array<long>"


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of non-empty sets, a row each."""
    out = np.empty((len(sets), MINIMA), np.uint32)
    at = 0
    while at < len(sets):
        to, total = at + 1, len(sets[at])
        while to < len(sets) and total + len(sets[to]) <= 1 << 15:
            total += len(sets[to])
            to += 1
        h = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]])]).astype(np.int64) if to - at > 1 else np.zeros(1, np.int64)
        work = np.empty_like(h)
        for k in range(MINIMA):
            np.multiply(h, _A[k], out=work)
            np.add(work, _B[k], out=work)
            out[at:to, k] = np.minimum.reduceat(work, starts)
        at = to
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima, as 64-bit words."""
    per = 64 // BITS
    fields = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(m), -1, per)
    return np.bitwise_or.reduce(fields << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from signatures: the share of equal fields, less those that agree by chance."""
    x = a ^ b
    shift = 1
    while shift < BITS:
        x = x | (x >> np.uint64(shift))
        shift *= 2
    ones = np.uint64(int(("0" * (BITS - 1) + "1") * (64 // BITS), 2))
    equal = 1 - np.bitwise_count(x & ones).sum(axis=-1) / MINIMA
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def floor_of(threshold: float) -> float:
    chance = 0.5**BITS
    p = chance + (1 - chance) * threshold
    return threshold - MARGIN * (p * (1 - p) / MINIMA) ** 0.5 / (1 - chance)


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    return mix((rows * _C).sum(axis=2, dtype=np.uint64) + (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)).view(np.int64)


def _sets(batch: pa.RecordBatch, column: int, width: int) -> list[np.ndarray]:
    data, at, nulls = strings(batch.column(column))
    return [shingles(word_hashes(b"" if n else bytes(data[a:b])), width) for a, b, n in zip(at, at[1:], nulls)]


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048, 4 << 20):
            sets = _sets(batch, 1, width)
            full = [i for i, s in enumerate(sets) if len(s)]
            m = minima([sets[i] for i in full])
            signatures, keys = packed(m), band_keys(m)
            sums = np.array([[s.sum(dtype=np.uint64), mix(s + np.uint64(1)).sum(dtype=np.uint64)] for s in (sets[i] for i in full)], dtype=np.uint64).reshape(-1, 2)
            classes, marks, bands = ([None] * len(sets) for _ in range(3))
            for row, i in enumerate(full):
                classes[i], marks[i], bands[i] = sums[row].tobytes(), signatures[row].tobytes(), keys[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "class", "signature", "bands"],
            )

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first columns, from batches in that order."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def _alike(least: float):
    """From rows (band, id, signature) in order of band: a star for each set of ids that alike pairs connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for group in _runs(batches, 1):
            ids = group.column("id").to_numpy()
            marks = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint64).reshape(len(ids), -1)
            left = np.arange(len(ids))
            while len(left) > 1:
                seed, todo, left = left[0], [left[0]], left[1:]
                while todo and len(left):
                    hit = estimate(marks[todo.pop()], marks[left]) >= least
                    found, left = left[hit], left[~hit]
                    for x in found.tolist():
                        forest.join(int(ids[x]), int(ids[seed]))
                    todo += found.tolist()
            if len(forest) >= BLOCK:
                yield forest.stars()
                forest = Forest()
        yield forest.stars()

    return run


def confirm(forest: Forest, ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int) -> None:
    """Joins the links among sets; if there are two sides, the links across. 100 |A and B| >= percent |A or B|."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, local = np.unique(flat, return_inverse=True)
    order = np.argsort(local, kind="stable")
    holders, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(local))])
    first = np.concatenate([[0], np.cumsum(sizes)])
    across = len(np.unique(sides)) > 1
    own_sets = Forest()
    joined = 0
    for x in range(len(sets)):
        if across and sides[x] != sides.min():
            continue
        own = local[first[x] : first[x + 1]]
        a, n = start[own], start[own + 1] - start[own]
        a, n = a[n > 1], n[n > 1]
        if not len(n):
            continue
        at = np.arange(n.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        common = np.bincount(holders[at], minlength=len(sets))
        hit = 100 * common >= percent * (sizes + sizes[x] - common)
        hit &= (sides != sides[x]) if across else (np.arange(len(sets)) > x)
        for y in np.flatnonzero(hit).tolist():
            a, b = int(ids[x]), int(ids[y])
            if new := own_sets.join(a, b):
                forest.join(a, b)
            joined += new
        if joined >= len(sets) - 1:
            break


def _checked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for group in _runs(batches, 3):
            ids, sides = group.column("id").to_numpy(), group.column("side").to_numpy()
            if len(ids) > 1:
                confirm(forest, ids, [np.frombuffer(x, np.uint64) for x in group.column("members").to_pylist()], sides, percent)
            if len(forest) >= BLOCK:
                yield forest.stars()
                forest = Forest()
        yield forest.stars()

    return run


def _listed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048, 4 << 20):
            sets = [s.tobytes() for s in _sets(batch, batch.schema.get_field_index("text"), width)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "cluster", "side", "blocks")), pa.array(sets, pa.binary())], ["id", "cluster", "side", "blocks", "members"])

    return run


def _dealt(classes: DataFrame) -> DataFrame:
    """Rows (id, n_shingles, cluster) with their block, side, and the number of their cluster's blocks."""
    weights = classes.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    spread = classes.join(weights.select("cluster", blocks.alias("blocks")), "cluster")
    return spread.select("id", "cluster", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("side"), "blocks")


def _confirmed(sets: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the links among sets (id, cluster, side, blocks, members), all of them. bands: (id, band)."""

    def links(meetings: DataFrame) -> DataFrame:
        return meetings.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "id").mapInArrow(_checked(percent), "u long, v long")

    columns = ["cluster", "i", "j", "id", "side", "members"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = sets.withColumns({"i": F.col("side"), "j": F.col("side")}).select(*columns)
    first = sets.where((F.col("side") < PIVOTS) & (F.col("blocks") > 1)).groupBy("cluster", "side").agg(F.min("id").alias("pivot"))
    pivots = sets.join(first.select("cluster", "side", F.col("pivot").alias("id")), ["cluster", "side", "id"]).select("*", every("blocks").alias("i")).where("i <> side")
    at_home = components(links(home.unionByName(pivots.withColumns({"j": F.col("i"), "side": F.col("i")}).select(*columns))))

    large = sets.where("blocks > 1").select("id", "cluster", F.floor(F.length("members") / 8).alias("n_shingles"))
    joined = large.join(at_home, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = joined.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("most"))
    outside = joined.join(largest, "cluster").where("component <> most")
    rest = written(_dealt(outside.select("id", "n_shingles", "cluster")).select("id", F.col("side").alias("part"), F.col("blocks").alias("parts")), "rest")
    if rest.isEmpty():
        return at_home
    # what shares a band with a part of the rest meets that part, and the part meets the blocks that hold such
    outer = sets.select("id", "cluster").join(rest, "id")
    touched = bands.join(outer, "id").select("band", "cluster", "part").distinct()
    near = bands.join(touched, "band").select("id", "cluster", "part").distinct()
    right = written(sets.join(near, ["id", "cluster"]).select("cluster", F.col("part").alias("i"), F.col("side").alias("j"), "id", F.lit(1).alias("side"), "members"), "near")
    meets = right.select("cluster", "i", "j").distinct()
    left = sets.join(rest, "id").select("cluster", F.col("part").alias("i"), "id", F.lit(0).alias("side"), "members").join(meets, ["cluster", "i"]).select(*columns)
    across = links(left.unionByName(right)).unionByName(at_home.select(F.col("id").alias("u"), F.col("component").alias("v")))
    return components(across)


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Each row's doc_id, n_shingles, component_id and kept (the smallest id of its component)."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), "text")
    signed = written(docs.mapInArrow(_signed(width), _SIGNED), "signed")
    full = signed.where("n_shingles > 0")
    classes = written(
        full.groupBy("class").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands")), "classes"
    )
    bands = classes.select("id", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    members = written(bands.join(shared, "band"), "members")
    small = members.where(F.col("n") <= BUCKET).join(classes.select("id", "signature"), "id").select("band", "id", "signature")
    alike = small.repartition("band").sortWithinPartitions("band", "id").mapInArrow(_alike(floor_of(percent / 100)), "u long, v long")
    edges = alike.unionByName(members.where(F.col("n") > BUCKET).select(F.col("id").alias("u"), F.col("first").alias("v")))
    clusters = components(edges).join(classes.select("id", "n_shingles"), "id")
    dealt = _dealt(clusters.withColumnRenamed("component", "cluster"))
    sets = written(dealt.join(docs.withColumnRenamed("doc_id", "id"), "id").mapInArrow(_listed(width), "id long, cluster long, side int, blocks int, members binary"), "sets")
    groups = _confirmed(sets, members.select("id", "band"), percent)
    named = classes.select("class", "id").join(groups, "id", "left").select("class", F.coalesce("component", "id").alias("component"))
    component = F.coalesce("component", "doc_id")
    real = lambda c: F.when(c != NONE, c)
    return signed.select("doc_id", "n_shingles", "class").join(named, "class", "left").select(
        real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(component).alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, that stay: of each group the one with the smallest id."""
    stay = near_groups(docs.select("doc_id", "text"), width, percent).where("kept or component_id is null").select(F.col("doc_id").alias("tessella_id_")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("tessella_id_")), "left_semi")


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


QUERIES = {"op2_bbit_minhash": op2_bbit_minhash}
SQL = {
    "op2_bbit_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
            FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
              ELSE list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+3], ' '))) END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
        b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
        m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.x = d.doc_id"""
}
