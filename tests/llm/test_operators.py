"""Each operator against a brute-force version, over nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import chat, edit_prints, exact_dedup, language, minhash, mixing, packing, secret_scan, sharding, tokens, warc
from tessella.llm.components import components
from tessella.llm.cuckoo import CuckooIndex
from tests_llm_brute import DE, EN, budgets, near, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, score double, component_id long, id long"
@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, EN if i % 2 else DE, rng.randrange(1, 160)), "en" if i % 2 else "de", f"src{i % 7}") for i in range(150)]
    base = [prose(rng, EN, 120).split() for _ in range(6)]
    for i in range(150, 260):  # near copies, some of them a few edits apart
        w = list(base[i % 6])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
        out.append((i, " ".join(w), "en", "src1"))
    out += [(i, "Same TEXT here, copied often", "en", "src2") for i in range(260, 300)]
    out += [(300, None, None, None), (301, "", "en", None), (302, " \n\t ", "en", "src3"), (303, "!!! 123 ???", None, "src3"), (304, "long " * 30_000, "en", "src4"), (305, "x" * 70_000, "en", "src4")]
    out += [(306, "twice the same row", "en", "src5")] * 2 + [(307, "ÄÖÜ ÄÖÜ äöü straße 😀 x y", "de", "src5"), (None, "no id here at all", "en", "src6")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, False, "d", 0.5, 9, 8) for i, t, lang, s in rows], SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_keeps_its_law(docs, rows, empty):
    got = sharding.shard(docs, (1.0, 2.0, 1.0, 4.0), (1.0,)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert all(r.grown_shard in (r.shard, 4) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.shard(empty, (1.0,)).count() == 0


def test_shards_fill_by_weight(spark):
    got = sharding.owners(spark.range(20_000).withColumnRenamed("id", "k"), "k", (1.0, 2.0, 1.0, 4.0), (2.0,)).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20_000 for r in got}
    assert all(abs(share[i] - w / 8) < 0.02 for i, w in enumerate((1, 2, 1, 4)))


def _groups(rows):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[hashlib.sha256((t or "").encode().translate(exact_dedup.ASCII_LOWER)).hexdigest()].append(i)
    return by


def test_exact_dedup(docs, rows, empty):
    by = _groups(rows)
    low = lambda i: -1 if i is None else i
    want = Counter((i, max(m, key=low), len(m), d) for d, m in by.items() for i in m)
    got = exact_dedup.dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(by.keys())
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    stay = exact_dedup.survivors(docs)
    assert stay.columns == docs.columns
    assert Counter(r.doc_id for r in stay.collect()) == Counter(max(m, key=low) for m in by.values())
    assert exact_dedup.dedup(empty).count() == 0 and exact_dedup.survivors(empty).count() == 0


def test_exact_dedup_hands_on_every_group(monkeypatch):
    import pyarrow as pa

    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(digests * 2, pa.binary()), *(pa.array(range(100), pa.int64()) for _ in range(2)), pa.array([1] * 100, pa.int64())], ["digest", "keep_id", "keep_uid", "group_size"])
    monkeypatch.setattr(exact_dedup, "OUT_ROWS", 7)
    got = [r for b in exact_dedup._folded(iter([batch])) for r in b.to_pylist()]
    assert {r["digest"]: (r["keep_id"], r["group_size"]) for r in got} == {d: (50 + i, 2) for i, d in enumerate(digests)} and len(got) == 50


def test_partitions_that_are_put_together_keep_apart(spark, docs, rows, monkeypatch):
    """Where several partitions are written by one task, rows and bins of each still have numbers of their own."""
    from tessella.sources import shared

    monkeypatch.setattr(shared, "sized", lambda df: df.coalesce(1))
    many = docs.repartition(23)
    kept = exact_dedup.dedup(many).where("kept").collect()
    assert Counter(r.text_sha256 for r in kept) == Counter(_groups(rows).keys())
    by = defaultdict(list)
    for r in packing.pack(many, 256).collect():
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256


def test_cuckoo_index_forgets_nothing_and_deletes():
    index, rng = CuckooIndex(8), random.Random(1)
    keys = [rng.randbytes(32) for _ in range(3000)]
    for n, k in enumerate(keys):
        assert index.find(k) < 0
        index.insert(k, (n, -n, 1))
    assert index.resized and all(index.get(index.find(k)) == (n, -n, 1) for n, k in enumerate(keys))
    for k in keys[::2]:
        assert index.delete(k) and not index.delete(k)
    assert all(index.find(k) < 0 for k in keys[::2]) and all(index.find(k) >= 0 for k in keys[1::2]) and index.live == 1500
    assert dict(index.items()) == {k: (n, -n, 1) for n, k in enumerate(keys) if n % 2}
    assert sum(bool(index.candidates(rng.randbytes(32))) for _ in range(5000)) < 25


def test_cuckoo_hits_are_verified_against_content():
    """Digests that agree in mark and buckets are told apart, and a filter that knows nothing finds nothing."""
    index = CuckooIndex(64)
    alike = [b"\x07\x00" + bytes(6) + bytes([k]) * 24 for k in range(8)]
    for n, k in enumerate(alike):
        index.insert(k, (n, n, n))
    assert all(len(index.candidates(k)) == 8 for k in alike) and [index.get(index.find(k))[0] for k in alike] == list(range(8)) and index.false_hits
    for slot in range(len(index.marks)):
        index.marks[slot] = 0
    assert all(index.find(k) < 0 for k in alike)


def test_exact_dedup_goes_through_the_filter(monkeypatch):
    """Without the filter's answer no copy is found: the index has no other way to what it stores."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([b"d" * 32] * 3, pa.binary()), *(pa.array([1, 5, 3], pa.int64()) for _ in range(2)), pa.array([2, 1, 1], pa.int64())], ["digest", "keep_id", "keep_uid", "group_size"])
    fold = lambda: [tuple(r.values())[1:] for b in exact_dedup._folded(iter([batch])) for r in b.to_pylist()]
    assert fold() == [(5, 5, 4)]
    monkeypatch.setattr(CuckooIndex, "candidates", lambda self, digest: [])
    assert len(fold()) == 3


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups_lose_no_link(docs, rows, width):
    some = [r for r in rows if r[0] is not None]
    want = near(some, width)
    got = minhash.near_groups(docs.where("doc_id is not null"), width).collect()
    assert len(got) == len(some)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_groups_in_blocks_and_large_buckets(docs, rows, empty, monkeypatch):
    """Every path of a large corpus, by smaller bounds."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    monkeypatch.setattr(minhash, "BUCKET", 3)
    some = [r for r in rows if r[0] is not None]
    got = minhash.near_groups(docs.where("doc_id is not null"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near(some, 4)
    assert minhash.near_groups(empty).count() == 0
    stay = minhash.representatives(docs)
    assert stay.columns == docs.columns and stay.where("doc_id is null").count() == 1


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for shared in (0, 500, 1000, 1800):
        a, b = np.unique(pool[:2000]), np.unique(pool[2000 - shared : 4000 - shared])
        true = shared / (4000 - shared)
        m = minhash.packed(minhash.minima([a, b]))
        assert abs(minhash.estimate(m[0], m[1:2])[0] - true) < 5 * 0.045


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a_, b_ = find(a), find(b)
        up[max(a_, b_)] = min(a_, b_)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_edit_prints(docs, rows, empty):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for k, (i, t, *_) in enumerate(ordered):
        t, n = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        want[i, len(t), hashlib.sha256(edit_prints.edited(t, n).encode()).hexdigest()] += 1
    got = edit_prints.fingerprints(docs, 9).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints, texts = defaultdict(set), {i: t or "" for i, t, *_ in rows}
    for r in got:
        prints[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert edit_prints.fingerprints(empty).count() == 0


def test_walks_alone_and_together_agree(monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, EN, rng.randrange(1, 80)) for _ in range(90)] + ["", "a"]
    together = edit_prints.prints(texts)
    monkeypatch.setattr(edit_prints, "TOGETHER", 10**9)
    assert edit_prints.prints(texts) == together


def test_few_edits_keep_prints_near(spark):
    rng = random.Random(4)
    texts = [prose(rng, EN + DE, 150) for _ in range(20)]
    changed = []
    for t in texts:
        for _ in range(4):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "q", "zz"]) + t[k + 1 :]
        changed.append(t)
    a, b = edit_prints.prints(texts), edit_prints.prints(changed)
    like, unlike = [edit_prints.likeness(x, y) for x, y in zip(a, b)], [edit_prints.likeness(x, y) for x, y in zip(a, a[1:])]
    # a walk takes a number of steps with a heavy tail to fall into step again, so single texts may lie lower
    assert np.median(like) > 0.6 and min(like) > max(unlike)
    links = {(r.doc_id, r.near_id) for r in edit_prints.near_texts(_print_table(spark, [*a, *b]), 0.5).collect()}
    assert {(20 + i, i) for i in range(20) if like[i] >= 0.7} <= links and all(x - y == 20 for x, y in links)


def _print_table(spark, prints):
    return spark.createDataFrame([(i, bytearray(edit_prints.packed(p))) for i, p in enumerate(prints)], "id long, print binary")


def _components_of(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_texts_lose_no_link_to_a_hub(spark, monkeypatch, block):
    monkeypatch.setattr(edit_prints, "BLOCK", block)
    rng = random.Random(9)
    licence, texts = prose(rng, EN, 40), []
    texts.append(licence + prose(rng, DE, 160))  # the smallest id shares only the opening
    for _ in range(12):
        t = licence + prose(rng, EN + DE, 160)
        for _ in range(2):
            k = rng.randrange(len(licence), len(t))
            texts.append(t[:k] + "q" + t[k + 1 :])
    texts.append(texts[3])
    prints = edit_prints.prints(texts)
    keys = [set(k) for k in edit_prints.band_keys([edit_prints.packed(p) for p in prints]).tolist()]
    want = [(i, j) for i in range(len(prints)) for j in range(i) if (keys[i] & keys[j] or prints[i] == prints[j]) and edit_prints.likeness(prints[i], prints[j]) >= 0.6]
    got = edit_prints.near_texts(_print_table(spark, prints), 0.6).collect()
    assert len(want) > 8 and _components_of(want) == _components_of([(r.doc_id, r.near_id) for r in got])
    assert all(abs(edit_prints.likeness(prints[r.doc_id], prints[r.near_id]) - r.likeness) < 1e-9 and r.likeness >= 0.6 for r in got)


def test_a_text_is_found_past_an_unlike_smallest_id(spark):
    """Texts 1 and 2 are alike; text 0 is unlike both, but shares one of their bands."""
    rng = random.Random(2)
    a, b = prose(rng, EN, 200), prose(rng, DE, 200)
    p = [edit_prints.packed(x) for x in edit_prints.prints([b, a, a[: len(a) * 19 // 20] + "!"])]
    like = edit_prints._compared(p[1:2], p[2:])[0]
    assert 0.8 < like < 1 and edit_prints._compared(p[:1], p[1:2])[0] < 0.5
    keys = edit_prints.band_keys(p)
    shared = int(next(k for k in keys[1] if k in keys[2]))
    real = edit_prints.band_keys
    try:
        edit_prints.band_keys = lambda prints_: np.array([[shared]] * len(prints_))
        import pyarrow as pa

        rows = pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int64()), pa.array(p, pa.binary())], ["id", "print"])
        members = [r for x in edit_prints._paired(edit_prints._banded(iter([rows]))) for r in x.to_pylist()]
    finally:
        edit_prints.band_keys = real
    assert [(m["id"], m["pivot"]) for m in members] == [(1, 0), (2, 0)]
    assert edit_prints._links([0, 1, 2], np.array([0, 0, 0]), p, 0.8) == [(2, 1, like)]


def test_near_ids_of_the_query(docs, rows):
    """The groups that near texts make, against all pairs."""
    texts = {}
    for i, t, *_ in rows:
        if i is not None:
            texts[i] = t or ""
    ids, prints = list(texts), edit_prints.prints(list(texts.values()))
    packed = [edit_prints.packed(p) for p in prints]
    want = [(ids[k], ids[j]) for k in range(len(ids)) for j in np.flatnonzero(edit_prints._compared(packed[:k], [packed[k]] * k) >= 0.8)] if len(ids) else []
    groups = _components_of(want)
    own = edit_prints.printed(docs).persist()
    got = {r.id: r.near_id for r in edit_prints.grouped(own).collect()}
    found = sum(got.get(a) is not None and got.get(a) == got.get(b) for a, b in want)
    assert len(want) > 100 and found >= 0.95 * len(want) and all(groups[i] <= n for i, n in got.items())
    out = edit_prints.fingerprints(docs, 7, edit_prints.grouped(own), own).collect()
    assert {r.doc_id: r.near_id for r in out if r.near_id is not None} == got
    plain = lambda rows_: sorted(str(tuple(r)[:-1]) for r in rows_)
    assert plain(out) == plain(edit_prints.fingerprints(docs, 7).collect())


@pytest.mark.parametrize("prints_", [["", "a", "ab", "a" * 3000, "é" * 10]])
def test_packed_likeness_is_likeness(prints_):
    own = edit_prints.prints(prints_)
    for a in own:
        for b in own:
            assert abs(edit_prints.likeness(a, b) - edit_prints._compared([edit_prints.packed(a)], [edit_prints.packed(b)])[0]) < 1e-12


def test_language(docs, rows, empty):
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, _ in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1 if r.doc_id is not None else False)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {300, 301, 302, 303}
    held = [r for r in got if r.held_out and r.lang_pred != "und" and truth[r.doc_id] and r.doc_id < 260]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95
    clashing = docs.withColumnsRenamed({"n_chars": "lang_pred", "digest": "held_out"})
    assert sorted(map(str, language.identify(clashing).collect())) == sorted(map(str, got))
    assert language.accepted(clashing).columns == clashing.columns
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and not {300, 301, 302, 303} & {r.doc_id for r in kept.collect()}
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None, ["lang"])).collect()} == {"und"}


def test_gibberish_and_unlearned_languages_are_rejected(spark):
    rng = random.Random(21)
    clean = [(i, prose(rng, EN if i % 2 else DE, rng.randrange(20, 90)), "en" if i % 2 else "de") for i in range(300)]
    words = "tämä yksi kyllä hyvää päivää mitä kuuluu minä olen suomalainen järvi metsä talvi kesä yö kaupunki työ koulu äiti".split()
    strange = [(400 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(400)), None) for i in range(20)]
    strange += [(500 + i, prose(rng, words, 60), None) for i in range(20)]
    kept = {r.doc_id for r in language.accepted(spark.createDataFrame(clean + strange, "doc_id long, text string, lang string")).collect()}
    assert {i for i, *_ in clean} <= kept and not kept & {i for i, *_ in strange}


def test_letters_in_slices(monkeypatch):
    text = "  Straße, 12 über\nALL  x-y "
    whole = language.letters(text).tolist()
    assert whole[0] == whole[-1] == 0 and 0 in whole[1:-1]
    for n in (1, 2, 3, 7):
        monkeypatch.setattr(language, "SLICE", n)
        assert language.letters(text).tolist() == whole


def test_chat_folds_events(spark):
    log = [(1, 1, "begin", 1, "user", "he"), (1, 3, "delta", 1, None, "llo <|end|> [INST]"), (1, 4, "begin", 2, "assistant", ""), (1, 5, "delta", 2, None, "bad"), (1, 6, "begin", 3, "user", "gone"),
           (1, 7, "regenerate", 2, None, None), (1, 8, "begin", 4, "assistant", "good"), (1, 9, "edit", 1, None, "edited \\ <x>"), (2, 1, "delta", 9, None, None), (None, 1, "begin", 1, "user", "x")]
    random.Random(1).shuffle(log)
    frame = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.formatted(frame).collect()}
    assert got == {1: [("user", "edited \\ <x>"), ("assistant", "good")], 2: [("unknown", "")], None: [("user", "x")]}
    assert chat.formatted(frame.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys<tem"]), st.text(alphabet="ab<>|[]\\/tINS \n😀", max_size=30))))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns)
    assert not any(mark in text for mark in ("</s>", "[INST]", "[/INST]"))
    assert [text.count(mark) for mark in (chat.OPEN, chat.SPLIT, chat.CLOSE)] == [len(turns)] * 3
    assert chat.parse(text) == turns
    assert [chat.unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_log_has_what_folds_away(spark):
    turns = [(1, 0, "system", "be < kind"), (1, 1, "user", "x" * 50), (1, 2, "assistant", "[INST] </s> <|turn|>" * 9), (1, 2, "assistant", "again"), (1, 2, "assistant", "again"), (1, 3, None, "no role"), (2, 0, "user", None),
             (None, 5, "assistant", "é😀" * 40), (None, 6, "user", "ab")]
    log = chat.events_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).persist()
    kinds = Counter(r.kind for r in log.collect())
    assert kinds["regenerate"] == 4 and kinds["edit"] == 4 and kinds["delta"] > 2 * len(turns)
    want = defaultdict(list)
    for c, _, role, text in sorted(turns, key=lambda t: (t[0] is None, t[0] or 0, t[1], t[2] or "", t[3] or "")):
        want[c].append((role or "unknown", text or ""))
    done = {r.conv_id: r for r in chat.formatted(log, partitioned=False).collect()}
    assert {c: chat.parse(r.formatted) for c, r in done.items()} == want
    assert all(chat.unescaped(r.formatted[s.begin : s.end]) == t for c, r in done.items() for s, t in zip(r.loss_spans, [t for role, t in want[c] if role == "assistant"], strict=True))


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    import base64

    monkeypatch.setattr(warc, "RECORDS", 2)
    rows = [(5, "u", "<a>é"), (2, "u", "<a>é"), (9, None, "<a>é"), (1, "a\r\nb", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (3, "u", None), (4, "u", ""), (7, "x", "one"), (None, "y", "one"), (8, "z", "y" * 300_000),
            (11, "p", "A"), (11, "p", "B"), (13, "p", "A"), (14, "p", "B"), (21, "q", "twice"), (21, "q", "twice"), (22, "q", "twice"), (30, "l", "\n\r\n\n" * 50), (31, "l", "ends\r")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha1 long")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "w"))).collect())
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = Counter()
    for i, _, html in rows:
        data, f = (html or "").encode(), first[html or ""]
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == f else "revisit", None if i == f else f] += 1
    assert got == want
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.resolved(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0
    alone = warc.read_archives(spark, str(tmp_path / "w")).where("record_id <> '<urn:x-page:2>'")
    with pytest.raises(Exception, match="no response for"):
        warc.resolved(alone).collect()


def _hf():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(docs, rows, empty):
    hf, got = _hf(), packing.pack(docs, 256).collect()
    by, texts = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in rows:
        texts[i].append(t or "")
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, own in texts.items():
        ids = np.array([*hf.encode(own[0], add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids) * len(own)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
        assert all(r.length == 256 for r in mine if r.piece)
    in_one_task = len(packing.best_fit(np.array([r.length for r in got]), 256)[2])
    assert len(by) <= 1.02 * in_one_task + 1
    assert packing.pack(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ranks_give_the_tokenizers_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    hf = _hf_once()
    assert tokens.ids(text).tolist() == hf.encode(text, add_special_tokens=False).ids


def _hf_once(made=[]):  # noqa: B006
    if not made:
        made.append(_hf())
    return made[0]


def test_added_tokens_have_their_ids(monkeypatch):
    end = "<|endoftext|>"
    for size in (1 << 19, 20):
        monkeypatch.setattr(tokens, "PART", size)
        for text in (f"a {end} b", end, end * 3, f"{end}start", f"stop {end}", f"some words here{end} and some more words, <|endoftext|x> {end[:-1]}", f"{'word ' * 9}{end}{' word' * 9}"):
            assert tokens.ids(text).tolist() == _hf_once().encode(text, add_special_tokens=False).ids, text


def test_long_texts_are_encoded_alike_in_parts(monkeypatch):
    text = prose(random.Random(3), EN + DE + ["  ", "\n\n", "don't", "42 42"], 900)
    whole = tokens.ids(text).tolist()
    monkeypatch.setattr(tokens, "PART", 50)
    assert len(tokens.parts(text, 50)) > 10 and np.concatenate([tokens.ids(p) for p in tokens.parts(text, 50)]).tolist() == whole


@pytest.mark.parametrize(("part", "epochs", "weights"), [(1.0, 4, None), (0.5, 1, None), (2.5, 3, None), (0.9, 1, 0.7), (2.0, 4, 0.3)])
def test_mixing(docs, empty, part, epochs, weights):
    got = mixing.mix(docs, part, epochs, weights=weights).collect()
    leaves, used, budget = Counter(), Counter(), {}
    for r in got:
        leaf = r.domain, r.lang, r.source
        leaves[leaf] += r.tokens
        used[leaf] += r.tokens * r.copies
        budget[leaf] = r.leaf_budget
    want = budgets(leaves, part, epochs, weights or mixing.WEIGHTS)
    for leaf, n in leaves.items():
        assert abs(budget[leaf] - want[leaf]) <= 1.01
        largest = max(r.tokens for r in got if (r.domain, r.lang, r.source) == leaf)
        assert budget[leaf] - largest < used[leaf] <= budget[leaf] <= n * epochs
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(docs, 0.5).columns == docs.columns


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secrets(spark, docs, rows, empty):
    rng = random.Random(6)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44))
    texts = {1: "é password = 'hunter2hunter2' x", 2: "token=short secret=token:abcdefghij", 3: "AKIA" + "A1" * 8 + " AKIAX " + "0af" * 11, 4: f"a {key} b", 5: "getUserAccountOrderPriceHandler set_user_account_order_total_count",
             6: "API_KEY: \"abcd.efgh-12\" api-key=zzzzzzzzzz", 7: None, 8: "donaudampfschifffahrtsgesellschaft thanbleshaningtionnt", 9: f"PassWD:{key}" * 3}
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, base long, runs long")
    table = secret_scan.train(secret_scan.labelled(spark, 4000))
    got = {r.doc_id: r for r in secret_scan.scan(frame.unionByName(docs.select("doc_id", "text", docs.n_chars.alias("base"), docs.n_chars.alias("runs")).where("doc_id > 20")), table).collect()}
    every = texts | {i: t for i, t, *_ in rows if i and i > 20}
    for i, t in every.items():
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert [(s.start, s.kind, s.end) for s in got[i].base] == sorted(want)
        assert {(s.start, s.kind, s.end) for s in got[i].base} <= {(s.start, s.kind, s.end) for s in got[i].spans}
    more = {i: [s.found for s in r.spans if s.kind == 3] for i, r in got.items()}
    assert more[4] == [key] and not more[5] and not more[8]
    assert secret_scan.scan(empty, table).count() == 0


def test_secret_models_tell_random_from_plain(spark):
    table = secret_scan.train(secret_scan.labelled(spark, 4000))
    from pyspark.sql import functions as F

    seen = secret_scan.labelled(spark, 4000).select("text")
    fresh = secret_scan.labelled(spark, 10_000).where(F.length("text") >= 20).join(seen, "text", "left_anti")
    assert fresh.count() > 8000
    hit = secret_scan._ratio(table, F.col("text")) >= F.greatest(F.lit(secret_scan.LEAST), secret_scan.LEAST_EACH * F.length("text"))
    share = {r["random"]: r["s"] for r in fresh.groupBy("random").agg(F.avg(hit.cast("double")).alias("s")).collect()}
    assert share[True] > 0.9 and share[False] < 0.01


def test_secrets_behind_paths_and_base_spans(spark):
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    path = lambda n: "/".join(rng.choice(secret_scan.WORDS) for _ in range(n))
    rows = [(i, f"see {path(words)}/{k} there", k) for i, (words, n) in enumerate([(8, 40)] * 50 + [(12, 40)] * 50 + [(8, 32)] * 50) for k in [key(n)]]
    rows += [(200 + i, f"AKIA{'A1' * 8}/{k}", k) for i in range(20) for k in [key(40)]]
    rows += [(300 + i, f"{path(8)}/{a}/{path(8)}/{b}", b) for i in range(20) for a, b in [(key(40), key(40))]]
    rows += [(1000 + i, path(12), "") for i in range(200)]
    table = secret_scan.train(secret_scan.labelled(spark, 4000))
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, k string"), table).collect()}
    found = lambda lo, hi: [any(s.kind == 3 and s.end - max(s.start, t.index(k)) >= 0.6 * len(k) for s in got[i]) for i, t, k in rows if lo <= i < hi]
    shares = [float(np.mean(found(*x))) for x in ((0, 50), (50, 100), (100, 150), (200, 220), (300, 320))]
    plain = float(np.mean([bool(got[i]) for i, *_ in rows if i >= 1000]))
    print("shares", shares, plain)
    assert min(shares) > 0.9 and plain <= 0.01
    assert all(s.found == t[s.start : s.end] for i, t, _ in rows for s in got[i])
    for n in (300, 310):
        assert sum(s.kind == 3 for s in got[n]) == 2
