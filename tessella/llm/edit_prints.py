"""Fingerprints by randomised edit embedding.

Random walks, shared by all texts, read a character at each step and move on or stay by a bit that depends on the step and the
character (Chakraborty, Goldenberg and Koucky, 2016). Texts a few edits apart fall back into step, so their edit distance
bounds the Hamming distance of what a walk reads. A fingerprint samples each of WALKS walks at 256 shared steps on two scales:
that of the text's length, rounded up to a power of two, and the next. Each sample keeps four bits, 0 after the text's end.
Likeness is the share of equal samples, where not both texts have ended, less what agrees by chance, of the walk by which the
texts are most alike: a single walk takes long to fall into step now and then.

`near_texts` samples bands: each takes the first PICKS samples, in a shuffled order of its own, at which the text has not
ended. Texts that share a band's samples meet the smallest id among them, and likeness verifies. Where one is unlike that, all
texts of the key are compared, in blocks, so that no link is lost to an unlike smallest id. `grouped` names the groups that
links make by their smallest id.

Defined cases: null is the empty text, whose fingerprint equals that of all empty texts; a null id comes last in
descending order and is near nothing; rows that repeat an id follow each other in an order that their texts alone give, and are one
text with the links of all; a single row is its own next; an empty table gives no rows; a very long text is walked alone, in memory of
its own size; further columns, also of the result's names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._arrow import pieces
from tessella.llm.components import components
from tessella.llm.storage import written

SAMPLES = 256
#: Steps after which the walk's bits repeat.
PERIOD = 4096
#: Agreement of samples of unlike texts.
CHANCE = 0.125
#: Fewer texts than this walk on one by one.
TOGETHER = 32
#: Characters of texts that walk at once.
CROWD = 8 << 20
NONE = -(2**63)
WALKS = 2
_rng = np.random.default_rng(424_242)
_MOVES = _rng.integers(0, 2, (WALKS, PERIOD, 256), dtype=np.int32)
_MOVES[:, :, 0] = 0
#: The moves of all walks at each step, one walk's behind the other's.
_ALL = np.ascontiguousarray(_MOVES.transpose(1, 0, 2).reshape(PERIOD, -1))
_SYMBOL = np.concatenate([[0], _rng.integers(1, 16, 255)]).astype(np.uint8)


def level(n: int) -> int:
    return max(3, (max(1, n) - 1).bit_length())


def steps(at: int) -> np.ndarray:
    """The sampled steps of a level: walks over texts of its length take about twice as many."""
    return np.sort(np.random.default_rng(9_000 + at).integers(0, int(2.125 * 2**at), SAMPLES))


def classes(text: str) -> np.ndarray:
    """1 to 255 for each code point, and a 0 at the end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.append((points * np.uint32(2_654_435_761) >> np.uint32(7)) % np.uint32(255) + np.uint32(1), 0).astype(np.uint8)


def _walk_alone(text: np.ndarray, wanted: np.ndarray, at: int, begin: int, out: np.ndarray, moves: list[bytes]) -> None:
    """From place `at` in a text and step `begin`: what stands at each wanted step."""
    data, last = text.tobytes(), len(text) - 1
    todo = int(np.searchsorted(wanted, begin))
    step = begin
    while todo < len(wanted) and at < last:
        for step in range(step, int(wanted[todo])):
            at += moves[step % PERIOD][data[at]]
        step = int(wanted[todo])
        at = min(at, last)
        while todo < len(wanted) and wanted[todo] == step:
            out[todo] = data[at]
            todo += 1


_BYTES: list[list[bytes]] = []


def _walked(texts: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """The classes that each walk over each text reads at the wanted (sorted) steps, 0 after its end, by walk and text.

    The walks of all texts go on together: the texts lie behind each other once for each walk, where a class is larger by 256."""
    if not _BYTES:
        _BYTES.extend([row.astype(np.uint8).tobytes() for row in own] for own in _MOVES)
    n, once = len(texts), np.concatenate(texts).astype(np.uint16)
    out = np.zeros((WALKS * n, len(wanted)), np.uint8)
    flat = np.concatenate([once + np.uint16(256 * w) for w in range(WALKS)])
    sizes = np.tile([len(t) for t in texts], WALKS)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    last = first + sizes - 1
    live, at, step = np.arange(WALKS * n), first.astype(np.int32), 0
    for k, to in enumerate(wanted.tolist()):
        while step < to and len(live) >= TOGETHER:
            stop = min(to, step + 128)
            read, move = np.empty(len(live), np.uint16), np.empty(len(live), np.int32)
            for j in range(step, stop):
                np.take(flat, at, out=read, mode="clip")
                np.take(_ALL[j % PERIOD], read, out=move, mode="clip")
                np.add(at, move, out=at)
            step = stop
            ended = at >= last[live]
            if ended.sum() * 10 > len(live):
                live, at = live[~ended], at[~ended]
        if len(live) < TOGETHER:
            for x, p in zip(live.tolist(), at.tolist()):
                _walk_alone(texts[x % n], wanted, p - int(first[x]), step, out[x], _BYTES[x // n])
            break
        out[live, k] = flat[at] & 255
    return out.reshape(WALKS, n, -1)


def prints(texts: list[str]) -> list[str]:
    """The fingerprint of each text: its level, and of each walk the samples of the level and the next, in hex."""
    found: dict[str, str] = {}
    by: dict[int, list[str]] = {}
    for t in dict.fromkeys(texts):
        by.setdefault(level(len(t)), []).append(t)
    for at, own in by.items():
        here, above = steps(at), steps(at + 1)
        wanted = np.unique(np.concatenate([here, above]))
        pick = np.concatenate([np.searchsorted(wanted, here), np.searchsorted(wanted, above)])
        size, begin = 0, 0
        for i, t in enumerate(own):
            size += len(t)
            if size >= CROWD or i == len(own) - 1:
                part = own[begin : i + 1]
                read = [classes(x) for x in part]
                symbols = np.concatenate([_SYMBOL[own][:, pick] for own in _walked(read, wanted)], axis=1)
                halves = symbols[:, ::2] << 4 | symbols[:, 1::2]
                for x, row in zip(part, halves):
                    h = row.tobytes().hex()
                    found[x] = ":".join([f"{at:02d}", *(h[k : k + SAMPLES] for k in range(0, len(h), SAMPLES))])
                size, begin = 0, i + 1
    return [found[t] for t in texts]


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = a.split(":"), b.split(":")
    low, high = (x, y) if int(x[0]) <= int(y[0]) else (y, x)
    gap = int(high[0]) - int(low[0])
    if gap > 1:
        return 0.0
    out = 0.0
    for w in range(WALKS):
        p, q = (np.frombuffer(s.encode(), np.uint8) for s in (low[1 + 2 * w + gap], high[1 + 2 * w]))
        told = (p != 48) | (q != 48)
        if told.any():
            out = max(out, float(((p == q)[told].mean() - CHANCE) / (1 - CHANCE)))
    return out


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many of the first characters of another, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_id long"


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bucket, tail, id, data, near_id, mark, print) in descending order of id within each bucket, the tail last.

    Rows without data, before those of their id, have its near_id, or the fingerprint of its text of that mark."""
    run: list[tuple[int, str, int | None, str | None]] = []
    following: list[tuple[str, str | None]] = []

    def out() -> pa.RecordBatch:
        own, n = [t for _, t, *_ in run], len(run)
        changed = [edited(t, f) for t, (f, _) in zip(own, following)]
        wanted = [*((t, p) for _, t, _, p in run), *following]
        unknown = [t for t, p in wanted if p is None]
        made = prints([*changed, *unknown])
        theirs, rest = made[:n], iter(made[n:])
        every = [p or next(rest) for _, p in wanted]
        mine, after = every[:n], every[n:]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if i == NONE else i for i, *_ in run], pa.int64()),
                pa.array(map(len, own), pa.int64()),
                pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
                pa.array(mine),
                pa.array(theirs),
                pa.array(map(likeness, mine, theirs), pa.float64()),
                pa.array(map(likeness, mine, after), pa.float64()),
                pa.array([x for _, _, x, _ in run], pa.int64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_id"],
        )

    size, last, bucket = 0, None, None
    told, near, known = None, None, {}
    for batch in pieces(batches, 1024, 4 << 20):
        for b, tail, i, data, other, mark, print_ in zip(*(c.to_pylist() for c in batch.columns)):
            if i != told:
                told, near, known = i, None, {}
            if data is None:
                if print_ is None:
                    near = other
                else:
                    known[mark] = unpacked(print_)
                continue
            raw = _UNPACK.decompress(data)
            text, print_ = raw.decode("utf-8", "surrogatepass"), known.get(_mark(raw)) if known else None
            if b != bucket:
                bucket, last = b, None
            if last is not None:
                run.append(last)
                following.append((text, print_))
                size += len(last[1])
            last = None if tail else (i, text, near, print_)
            if size >= CROWD:
                yield out()
                run.clear()
                following.clear()
                size = 0
    if run:
        yield out()


_UNPACK = zstandard.ZstdDecompressor()
_ROWS = "bucket int, tail boolean, id long, data binary, near_id long, mark long, print binary"


def _mark(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


def _placed(cuts: np.ndarray):
    """Rows (id, text), (id, near_id) or (id, mark, print), with text compressed, by the range of their id; the text of a range's last cut also ends the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        names = [c.split()[0] for c in _ROWS.split(", ")]
        for batch in pieces(batches, 4096, 4 << 20):
            ids, n = batch.column(0).to_numpy(), batch.num_rows
            at = np.searchsorted(cuts, ids).astype(np.int32)
            more = {"data": pa.nulls(n, pa.binary()), "near_id": pa.nulls(n, pa.int64()), "mark": pa.nulls(n, pa.int64()), "print": pa.nulls(n, pa.binary())}
            own = dict(zip(batch.schema.names[1:], batch.columns[1:]))
            text = own.pop("text", None)
            more |= own
            if text is not None:
                data = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in text.to_pylist()]
                more["data"] = pa.array(data, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(n, bool)), pa.array(ids), *(more[c] for c in names[3:])], names)
            also = np.flatnonzero(cuts[at] == ids) if text is not None else ()
            if len(also):
                nulls = [pa.nulls(len(also), t) for t in (pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array((at[also] + 1) % len(cuts), pa.int32()), pa.array(np.ones(len(also), bool)), pa.array(ids[also]), pa.array([data[k] for k in also], pa.binary()), *nulls], names)

    return run


def fingerprints(docs: DataFrame, buckets: int | None = None, near: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document in descending order of id.

    Ids are cut into ranges at ids that occur. A range's first document also goes to the range before, as its tail, so that
    each range is worked on alone; texts travel once, compressed. near: (id, near_id), to be handed on with their documents;
    known: (id, mark, print), fingerprints that need not be made again."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or 4 * parts
    marks = docs.agg(F.percentile_approx("id", F.lit([float(k / n) for k in range(1, n + 1)]), 20_000).alias("m"), F.max("id").alias("top")).first()
    cuts = np.array(sorted({*(marks["m"] or []), *([marks["top"]] if marks["top"] is not None else [])}), dtype=np.int64)
    rows = docs.mapInArrow(_placed(cuts), _ROWS)
    for more, columns in ((near, ("id", "near_id")), (known, ("id", "mark", "print"))):
        if more is not None:
            rows = rows.unionByName(more.select(*columns).mapInArrow(_placed(cuts), _ROWS))
    order = ["bucket", "tail", F.desc("id"), F.asc_nulls_first("data")]
    return rows.repartition(parts, "bucket").sortWithinPartitions(*order).mapInArrow(_printed, _RESULT)


#: Bands of each scale of each walk, and samples that make one.
BANDS, PICKS = 8, 12
#: Texts of a band key that a task compares with each other, or with as many others.
BLOCK = 1024
_picks = np.random.default_rng(31_337)
_ORDER = np.array([_picks.permutation(SAMPLES) for _ in range(BANDS)])
_WORTH = _picks.integers(0, 2**64, (WALKS, BANDS, SAMPLES, 16), dtype=np.uint64)


def _symbols(prints_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Levels, and the samples by walk and scale, of packed fingerprints."""
    raw = np.frombuffer(b"".join(prints_), np.uint8).reshape(len(prints_), 1 + WALKS * SAMPLES)
    halves = raw[:, 1:].reshape(len(prints_), WALKS, 2, SAMPLES // 2)
    return raw[:, 0].astype(np.int64), np.stack([halves >> 4, halves & 15], axis=4).reshape(len(prints_), WALKS, 2, SAMPLES)


def packed(fingerprint: str) -> bytes:
    level_, *samples = fingerprint.split(":")
    return bytes([int(level_)]) + bytes.fromhex("".join(samples))


def unpacked(print_: bytes) -> str:
    h = print_[1:].hex()
    return ":".join([f"{print_[0]:02d}", *(h[k : k + SAMPLES] for k in range(0, len(h), SAMPLES))])


def band_keys(prints_: list[bytes]) -> np.ndarray:
    """A row of WALKS x 2 x BANDS keys for each packed fingerprint. A scale's keys are the same for texts of the level and the next."""
    levels, samples = _symbols(prints_)
    out = np.empty((len(prints_), WALKS, 2, BANDS), np.uint64)
    for walk in range(WALKS):
        for scale in (0, 1):
            for band, order in enumerate(_ORDER):
                own = samples[:, walk, scale][:, order]
                live = own > 0
                taken = live & (np.cumsum(live, axis=1) <= PICKS)
                place = ((levels + scale) * WALKS + walk) * BANDS + band + 1
                out[:, walk, scale, band] = np.where(taken, _WORTH[walk, band, order, own], 0).sum(axis=1, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15) * place.astype(np.uint64)
    return out.reshape(len(prints_), -1).view(np.int64)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, print) from rows (id, text). Many texts walk together."""
    for batch in pieces(batches, 1 << 14, CROWD):
        texts = batch.column(1).to_pylist()
        marks = [_mark(t.encode("utf-8", "surrogatepass")) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), pa.array(map(packed, prints(texts)), pa.binary())], ["id", "mark", "print"])


def _firsts(batch: pa.RecordBatch) -> dict[bytes, list[int]]:
    """The ids of each fingerprint of a batch (id, print), the smallest first."""
    by: dict[bytes, list[int]] = {}
    for i, p in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        by.setdefault(p, []).append(i)
    return by


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id): the band keys of each fingerprint of a batch, for the smallest of its ids."""
    for batch in pieces(batches, 8192, 4 << 20):
        if by := _firsts(batch):
            keys, ids = band_keys(list(by)), np.array([own[0] for own in by.values()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], ["key", "id"])


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, pivot): ids of a batch beside the smallest of the same fingerprint."""
    for batch in pieces(batches, 8192, 4 << 20):
        found = [(i, own[0]) for own in _firsts(batch).values() for i in own[1:] if i != own[0]]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([p for _, p in found], pa.int64())], ["id", "pivot"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, id) in that order: those of keys of several ids, with the smallest."""
    key = pivot = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate([[keys[0] != key], keys[1:] != keys[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
        pivots = np.where(start >= 0, ids[np.maximum(start, 0)], pivot if pivot is not None else 0)
        key, pivot = keys[-1], pivots[-1]
        at = np.flatnonzero(ids != pivots)
        yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(ids[at]), pa.array(pivots[at])], ["key", "id", "pivot"])


def _compared(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The likeness of pairs of packed fingerprints."""
    (la, sa), (lb, sb) = _symbols(a), _symbols(b)
    gap, rows = lb - la, np.arange(len(a))
    mine, theirs = sa[rows, :, np.clip(gap, 0, 1)], sb[rows, :, np.clip(-gap, 0, 1)]  # by walk
    told = (mine > 0) | (theirs > 0)
    n = told.sum(axis=2)
    share = ((mine == theirs) & told).sum(axis=2) / np.maximum(n, 1)
    best = np.where(n == 0, 0.0, np.maximum(0.0, (share - CHANCE) / (1 - CHANCE))).max(axis=1)
    out = np.where(np.abs(gap) > 1, 0.0, best)
    return np.where([x == y for x, y in zip(a, b)], 1.0, out)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 4096, 4 << 20):
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_compared(a, b) if a else [], pa.float64())], ["doc_id", "near_id", "likeness"])


def _links(ids: list[int], own: np.ndarray, prints_: list[bytes], least: float) -> list[tuple[int, int, float]]:
    """A link from each text, in order of id, to the first that is like it in each group that links have made so far: no group is split.

    own: the side of each; if there are two, only texts of different sides are compared."""
    groups, out = np.arange(len(ids)), []
    across = own.min() != own.max()
    for k in range(1, len(ids)):
        found = _compared(prints_[:k], [prints_[k]] * k)
        near = np.flatnonzero((found >= least) & ((own[:k] != own[k]) | (not across)))
        for g in np.unique(groups[near]):
            x = near[groups[near] == g][0]
            out.append((ids[k], ids[x], float(found[x])))
        if len(near):
            groups[np.isin(groups, groups[near])] = groups[k] = groups[near].min()
    return out


def _linked(least: float):
    """From rows (key, i, j, own, id, print) in order of the first three and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            found = _links([r[1] for r in rows], np.array([r[0] for r in rows]), [r[2] for r in rows], least) if len(rows) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "near_id", "likeness"])

        for batch in batches:
            for *k, own, i, p in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    yield from out()
                    key, rows = k, []
                rows.append((own, i, p))
        yield from out()

    return run


def printed(docs: DataFrame) -> DataFrame:
    """(id, mark, print): the packed fingerprint of each text that has an id, and a number that tells its texts apart."""
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(_own, "id long, mark long, print binary")


def near_texts(prints_: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, near_id, likeness): links between texts (id, print), a written table, that share a band, verified by likeness.

    Links that join no new texts are left out. A task combines what it reads: of equal fingerprints only one id has bands.
    First each text of a key meets the smallest id; where that fails for any, all of the key are compared, in blocks whose
    pairs are dealt out: components are those of all pairs. Those comparisons grow with the square of such a key's texts."""
    same = prints_.mapInArrow(_copies, "id long, pivot long").select(F.col("id").alias("doc_id"), F.col("pivot").alias("near_id"), F.lit(1.0).alias("likeness"))
    members = written(prints_.mapInArrow(_banded, "key long, id long").repartition("key").sortWithinPartitions("key", "id").mapInArrow(_paired, "key long, id long, pivot long"), "members")
    pairs = members.select("id", "pivot").distinct()
    # fingerprints of all texts are dealt once, to find those that share a band
    met_ = members.select(F.explode(F.array("id", "pivot")).alias("id")).distinct()
    prints_ = written(prints_.join(met_, "id", "left_semi"), "met")
    both = pairs.join(prints_, "id").join(prints_.select(F.col("id").alias("pivot"), F.col("print").alias("other")), "pivot").select("id", "pivot", "print", "other")
    verified = written(both.mapInArrow(_verified, "doc_id long, near_id long, likeness double").groupBy("doc_id", "near_id").agg(F.max("likeness").alias("likeness")), "verified")
    links = verified.where(F.col("likeness") >= least)
    failed = verified.where(F.col("likeness") < least).select(F.col("doc_id").alias("id"), F.col("near_id").alias("pivot"))
    open_ = members.join(failed, ["id", "pivot"]).groupBy("key").agg(F.first("pivot").alias("pivot"))
    rest = members.join(open_.select("key"), "key").select("key", "id").unionByName(open_.select("key", F.col("pivot").alias("id")))
    sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rest.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = dealt.join(prints_, "id").select("key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "id", "print")
    found = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(_linked(least), "doc_id long, near_id long, likeness double")
    return same.unionByName(links).unionByName(found).where("doc_id <> near_id").distinct()


def grouped(prints_: DataFrame, least: float = 0.8) -> DataFrame:
    """(id, near_id) of each text of a written table (id, print) that is near another: the smallest id that links lead to, itself included."""
    links = near_texts(prints_.select("id", "print"), least)
    return components(links.select(F.col("doc_id").alias("u"), F.col("near_id").alias("v"))).select("id", F.col("component").alias("near_id"))


def op3_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = written(printed(docs), "prints")
    return fingerprints(docs, near=grouped(own), known=own)


QUERIES = {"op3_edit_embedding": op3_edit_embedding}
