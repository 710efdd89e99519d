"""Language ID by hyperdimensional profiles.

Letters have random vectors of +1 and -1. A trigram binds its letters' vectors, each turned by its place, by
multiplication; a text bundles its trigrams by addition; a language's prototype bundles its training texts. The prototypes'
common part is taken off, and a text gets the language whose prototype has the largest cosine with it.

The largest of the centred cosines is never negative, so the score can't tell that a text is in no learned language.
`accepted` goes by the cosine of a text's distinct trigrams with the language's prototype as it was before the common part
went: half of the median of the learning texts of that language and of about as many distinct trigrams is the least. Where
few such texts are learned from, as in tiny tables, the median is theirs, whatever they are.

Words are runs of letters (Unicode), lower-cased, with one boundary between two; the same for the text's ends.

Defined cases: null text, and text without a letter, is `und` with score 0, as is all text if nothing could be learned;
ties go to the language that sorts first; rows that repeat are each predicted alike; an empty table gives no rows; a very
long text is read in slices; further columns, also of the result's names, are not looked at. The driver gets DIM numbers for
each distinct label, so labels are meant to be languages, some hundreds at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._arrow import pieces

DIM = 512
LETTERS = 128
UND = "und"
#: The least score there can be once two languages are learned; less is rejected where one is.
LEAST_SCORE = 0.5
#: Of the median cosine of learning texts, the part that a text must reach.
LEAST_PART = 0.5
#: Classes of length, in distinct trigrams: each is twice as long as the one before.
CLASSES = 20
_rng = np.random.default_rng(5_150)
_SIGNS = _rng.choice(np.array([-1, 1], np.int8), (LETTERS, DIM))
#: Of characters that are turned into letter codes at once.
SLICE = 1 << 20
#: Trigrams whose vectors a task keeps, and those whose vectors it works on at once.
CACHED, PART = 1 << 15, 1024


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """A code for each code point: 0 for what is no letter, a code of its own for a-z and Latin-1, shared ones beyond."""
    table = np.zeros(0x110000, np.uint8)
    own = {chr(c): i + 1 for i, c in enumerate([*range(97, 123), *(c for c in range(0xDF, 0x100) if c != 0xF7)])}
    shared = LETTERS - 1 - len(own)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()[0]
            table[c] = own.get(low) or 1 + len(own) + (ord(low) * 2_654_435_761 >> 7) % shared
    return table


def letters(text: str) -> np.ndarray:
    """Letter codes with a single 0 between words and at both ends; empty if there is no letter."""
    out, last = [], np.zeros(1, np.uint8)
    for at in range(0, len(text), SLICE):
        c = _codes()[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")]
        c = np.concatenate([last, c])
        last = c[-1:]
        out.append(c[1:][(c[1:] != 0) | (c[:-1] != 0)])
    codes = np.concatenate([np.zeros(1, np.uint8), *out]) if out else np.zeros(0, np.uint8)
    if not codes.any():
        return np.zeros(0, np.uint8)
    return codes if codes[-1] == 0 else np.append(codes, np.uint8(0))


def trigrams(text: str) -> np.ndarray:
    c = letters(text).astype(np.int32)
    return (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]


def vectors(ids: np.ndarray) -> np.ndarray:
    """A row for each trigram: its letters' vectors, turned by two, one and no places, multiplied."""
    a, b, c = ids // (LETTERS * LETTERS), ids // LETTERS % LETTERS, ids % LETTERS
    return np.roll(_SIGNS, 2, axis=1)[a] * np.roll(_SIGNS, 1, axis=1)[b] * _SIGNS[c]


class _Vectors:
    """Rows by trigram, kept between texts within a bound."""

    def __init__(self) -> None:
        self.row = np.full(LETTERS**3, -1, np.int32)
        self.made = np.zeros((0, DIM), np.int8)
        self.used = 0

    def of(self, ids: np.ndarray) -> np.ndarray:
        if self.used + len(ids) > CACHED:
            if len(ids) > CACHED:
                return vectors(ids)
            self.row.fill(-1)
            self.used = 0
        new = ids[self.row[ids] < 0]
        if len(new):
            if self.used + len(new) > len(self.made):
                grown = np.zeros((min(CACHED, max(4096, 2 * (self.used + len(new)))), DIM), np.int8)
                grown[: self.used] = self.made[: self.used]
                self.made = grown
            self.row[new] = np.arange(self.used, self.used + len(new))
            self.made[self.used : self.used + len(new)] = vectors(new)
            self.used += len(new)
        return self.made[self.row[ids]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, trigram, n) of each slice of rows (lang, text)."""
    for batch in pieces(batches, 8192, 8 << 20):
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(trigrams(text))
        for lang, found in by.items():
            ids, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids), pa.array(n)], ["lang", "trigram", "n"])


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in pieces(batches, 8192, 64 << 20):
        langs, ids = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
        n = batch.column(2).to_numpy().astype(np.float64)
        for lang in dict.fromkeys(langs):
            at = langs == lang
            sums[lang] = sums.get(lang, 0) + n[at] @ vectors(ids[at]).astype(np.float64)
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM, pa.string()), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], ["lang", "dim", "v"])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def bundles(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of rows (lang, text), sorted, and the unit vector of each one's bundle. The driver gets DIM numbers a language."""
    counts = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_counted, "lang string, trigram int, n long")
    totals = counts.groupBy("lang", "trigram").agg(F.sum("n").alias("n"))
    rows = totals.mapInArrow(_bundled, "lang string, dim int, v double").groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r["lang"] for r in rows})
    out = np.zeros((len(langs), DIM))
    for r in rows:
        out[langs.index(r["lang"]), r["dim"]] = r["v"]
    return langs, _unit(out)


def centred(plain: np.ndarray) -> np.ndarray:
    return _unit(plain - plain.mean(axis=0)) if len(plain) > 1 else plain


def prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of rows (lang, text), sorted, and a unit vector for each, without their common part."""
    langs, plain = bundles(labelled)
    return langs, centred(plain)


def class_of(n: int) -> int:
    return min(CLASSES - 1, n.bit_length())


def _predicted(langs: list[str], profiles: np.ndarray, column: str, plain: np.ndarray | None = None):
    """With plain profiles also the distinct trigrams' cosine with the predicted language's, and the class of length."""
    profiles = profiles.astype(np.float32).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Vectors()
        for batch in pieces(batches, 2048, 4 << 20):
            names, scores, nears, sizes = [], [], [], []
            for text in batch.column(batch.schema.get_field_index(column)).to_pylist():
                ids = trigrams(text) if text and langs else ()
                if not len(ids):
                    names.append(UND)
                    scores.append(0.0)
                    nears.append(0.0)
                    sizes.append(0)
                    continue
                ids, n = np.unique(ids, return_counts=True)
                sizes.append(class_of(len(ids)))
                bundle, once = np.zeros(DIM, np.float32), np.zeros(DIM, np.float32)
                for at in range(0, len(ids), PART):
                    rows = cache.of(ids[at : at + PART]).astype(np.float32)
                    bundle += n[at : at + PART].astype(np.float32) @ rows
                    if plain is not None:
                        once += rows.sum(axis=0)
                cosines = bundle @ profiles / max(float(np.linalg.norm(bundle)), 1e-12)
                best = int(np.argmax(cosines))
                names.append(langs[best])
                scores.append(min(1.0, max(0.0, (1.0 + float(cosines[best])) / 2)))
                nears.append(float(once @ plain[best]) / max(float(np.linalg.norm(once)), 1e-12) if plain is not None else 0.0)
            more = {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}
            if plain is not None:
                more |= {"near": pa.array(nears, pa.float64()), "size": pa.array(sizes, pa.int32())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    return run


def predict(docs: DataFrame, langs: list[str], profiles: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",), plain: np.ndarray | None = None) -> DataFrame:
    """The kept columns with lang_pred and score, and with near and size if there are plain profiles; only the text is looked at."""
    source = docs.select(*dict.fromkeys([*keep, text]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(_predicted(langs, profiles, text, plain), f"{kinds}, lang_pred string, score double" + (", near double, size int" if plain is not None else ""))


def held_out(docs: DataFrame) -> DataFrame:
    """Every document has a fold by its id; one fold of three is never learned from."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False)))


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return prototypes(held_out(docs.select("doc_id", "lang", "text")).where(~F.col("held_out")))


def identify(docs: DataFrame) -> DataFrame:
    langs, profiles = learned(docs)
    return held_out(predict(docs, langs, profiles)).select("doc_id", "held_out", "lang_pred", "score")


def floors(labelled: DataFrame, langs: list[str], plain: np.ndarray) -> np.ndarray:
    """The least cosine by language and class of length, from rows (lang, text); a class without texts has that of the nearest one below, or above."""
    found = predict(labelled.where("lang is not null and text is not null"), langs, centred(plain), keep=("lang",), plain=plain).where("lang_pred = lang")
    out = np.full((len(langs), CLASSES), np.nan)
    for r in found.groupBy("lang", "size").agg(F.percentile_approx("near", 0.5).alias("m")).collect():  # CLASSES rows a language at most
        out[langs.index(r["lang"]), r["size"]] = LEAST_PART * r["m"]
    for row in out:
        known = np.flatnonzero(~np.isnan(row))
        for k in range(CLASSES) if len(known) else ():
            row[k] = row[max((x for x in known if x <= k), default=known[0])]
    return np.nan_to_num(out)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that have a language: no `und`, and none that its language's prototype is too far from."""
    learning = held_out(docs.select("doc_id", "lang", "text")).where(~F.col("held_out"))
    langs, plain = bundles(learning)
    least = floors(learning, langs, plain) if langs else np.zeros((0, CLASSES))
    own = [f"own_{c}" for c in docs.columns]
    found = predict(docs.withColumnsRenamed(dict(zip(docs.columns, own))), langs, centred(plain), "own_text", tuple(own), plain)
    enough = F.lit(False)
    for lang, row in zip(langs, least.tolist()):
        enough = F.when(F.col("lang_pred") == lang, F.col("near") >= F.element_at(F.lit(row), F.col("size") + 1)).otherwise(enough)
    return found.where((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SCORE) & enough).select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)])


def op5_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_hyperdimensional_language": op5_hyperdimensional_language}
