"""The registered queries and the pipeline over a small table, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tessella.llm import catalogue, edit_prints, exact_dedup, language, mixing
from tests_llm_brute import EN, DE, budgets, near, prose


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [(i, prose(rng, EN if i % 3 else DE, rng.randrange(20, 90)), "en" if i % 3 else "de", f"src{i % 12}", 1) for i in range(120)]
    rows += [(i, rows[i % 7][1].upper() if i % 2 else rows[i % 7][1] + " end", "en", "src1", 1) for i in range(120, 160)]
    rows += [(160, None, None, None, 0), (161, "?!", "en", "src2", 2), (162, "a secret: abcdefgh12345 and token = " + "z9" * 20, "en", "src2", 3)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    return str(d), rows


def test_each_operator_has_one_query():
    names = catalogue.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(names) | {"pipeline"} <= set(__spark_entry__.queries()) and set(catalogue.oracle_sql()) <= set(names)


def test_queries_without_sql(spark, sf):
    d, rows = sf
    texts = {i: t or "" for i, t, *_ in rows}
    q = catalogue.queries()
    shards = {r.doc_id: r for r in q["op1_rendezvous_sharding"](spark, d).collect()}
    assert len(shards) == len(rows) and all(0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) and r.text_crc32 == zlib.crc32(texts[i].encode()) for i, r in shards.items())
    ordered = sorted(texts, reverse=True)
    for r in q["op3_edit_embedding"](spark, d).collect():
        following = texts[ordered[(ordered.index(r.doc_id) + 1) % len(ordered)]]
        assert r.edited_sha256 == hashlib.sha256(edit_prints.edited(texts[r.doc_id], following).encode()).hexdigest()
        assert r.near_edited >= r.near_next or r.n_chars < 40
    assert {r.doc_id for r in q["op5_hyperdimensional_language"](spark, d).collect() if r.lang_pred == "und"} == {160, 161}
    packed = q["op9_residual_packing"](spark, d).collect()
    assert {r.doc_id for r in packed} == set(texts) and max(r.offset + r.length for r in packed) <= 2048
    found = {r.doc_id: r for r in q["op10_markov_secrets"](spark, d).collect()}
    assert (found[162].n_assign, found[162].n_access, found[162].n_hex) == (2, 0, 0) and found[160].base_sha256 == hashlib.sha256(b"").hexdigest()


def _after_language(rows):
    """The languages' bundles, in NumPy, without Spark."""
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    sums = defaultdict(lambda: np.zeros(language.DIM))
    for i, t, lang, *_ in rows:
        if lang and t and not held[i] and len(x := language.trigrams(t)):
            sums[lang] += language.vectors(x).astype(float).sum(axis=0)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    m = unit(np.array([sums[x] for x in sorted(sums)]))
    m = unit(m - m.mean(axis=0))
    score = lambda t: (1 + float((m @ unit(language.vectors(language.trigrams(t)).astype(float).sum(axis=0))).max())) / 2
    return [r for r in rows if r[1] and len(language.trigrams(r[1])) and score(r[1]) >= language.LEAST_SCORE]


def test_pipeline(spark, sf):
    d, rows = sf
    rows = _after_language(rows)
    by = {}
    for r in sorted(rows):
        by[r[1].encode().translate(exact_dedup.ASCII_LOWER)] = r
    rows = list(by.values())
    comp = near(rows, 5)
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    leaf = lambda r: (next((mixing.DOMAINS[k] for k in [int(r[3][3:]) // 5] if k < 4), "other"), r[2], r[3])
    size = lambda r: max(1, -(-len(r[1].encode()) // 4))
    supply = Counter()
    for r in rows:
        supply[leaf(r)] += size(r)
    want, room = set(), {k: int(v + 1e-6) for k, v in budgets(supply, corpus_pipeline.MIX_PART, 1, corpus_pipeline.MIX_POWER).items()}
    through = Counter()
    for r in sorted(rows, key=lambda r: hashlib.md5(f"{mixing.SEED}:{int(room[leaf(r)] // supply[leaf(r)])}:{r[0]}".encode()).hexdigest()[:12]):
        through[leaf(r)] += size(r)
        if through[leaf(r)] <= room[leaf(r)]:
            want.add(r[0])
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} == want
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
        assert stage(spark, docs.limit(0), d).count() == 0, name
