"""Operators on whole tables against brute force, exact round trips or bounds."""

import hashlib
import inspect
import math
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialoom.llm import ann, ngram_lm, packing, simhash, warc
from dialoom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_print(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """doc_id -> smallest doc_id reachable at 2 bits."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 2):
            a, b = root(i), root(ids[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_query(spark, sf):
    for sf in (sf, "/root/testdata/sf0.01"):
        got = {r.doc_id: r for r in simhash.op1_simhash(spark, sf).collect()}
        prints = {r.doc_id: plain_print(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
        assert {i: r.component_id for i, r in got.items()} == plain_components(prints)
        assert len(set(plain_components(prints).values())) < len(prints)


def test_simhash_shards_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    flips = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base[:150] for i, j in rng.integers(0, 64, (3, 2))]
    ball = [base[0] ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(20) for j in range(i)]
    prints = np.unique(np.concatenate([base, np.array(flips), np.array(ball)]))
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(prints.view(np.int64).tolist())], "doc_id long, fp long")
    links = simhash.link_fingerprints(df.select("fp"), shard=60)
    roots = {r.node: r.root for r in components(links).collect()}
    groups = defaultdict(set)
    for r in df.collect():
        groups[roots.get(r.fp, r.fp)].add(r.doc_id)
    mine = {i: min(g) for g in groups.values() for i in g}
    assert mine == plain_components({i: int(v) for i, v in enumerate(prints.tolist())})
    a, b = simhash.near_links(prints, leaf=32)
    assert (np.bitwise_count(a ^ b) <= 2).all() and len(a) < len(prints)


def test_simhash_on_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    assert by[10].component_id == by[9].component_id == 8 and by[None].component_id is None
    assert simhash.near_duplicates(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(i, 100) for i in range(101, 140)] + [(5, 5), (7, None), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    long = "".join(f"<p>{i}é</p>\r\n\r\nWARC/1.1\r\n" for i in range(9000))
    rows = [(5, "http://a", "x" * 100), (3, "http://b\r\nX: y", "x" * 100), (9, None, "x" * 100), (1, "u", "x" * 99), (2, "u", "x" * 99), (4, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (8, "u", long), (None, "u", "y" * 200), (10, "u", "y" * 200)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(warc.chunk_rows(warc.mark_revisits(pages), chunk=1000), path, records_per_file=7)
    chunks = warc.read(spark, path, batch_bytes=5000)
    back = warc.records(chunks).collect()
    assert len(back) == pages.count() and all(r.intact for r in back)
    want = Counter()
    for r in pages.collect():
        data = (r.html or "").encode()
        first = {"x" * 100: 3, "y" * 200: 10}.get(r.html, 7 if len(data) > 1000 else None)
        refers = first if first not in (None, r.page_id) else None
        want[r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == want
    whole = chunks.where("page_id = 7").orderBy("chunk").collect()
    assert b"".join(bytes(r.data) for r in whole).decode() == pages.where("page_id = 7").first().html


def test_warc_revisits_name_a_record_and_truncated_archives_show(spark, pages, tmp_path):
    path = f"{tmp_path}/w"
    warc.write(warc.chunk_rows(warc.mark_revisits(pages.coalesce(1)), chunk=1000), f"file://{path}", records_per_file=100_000)
    (name,) = [f"{path}/{x}" for x in os.listdir(path) if x.endswith(".gz")]
    headers = [h for h, _ in warc.parse(open(name, "rb").read())]
    responses = {h["warc-record-id"] for h in headers if h["warc-type"] == "response"}
    named = [h["warc-refers-to"] for h in headers if h["warc-type"] == "revisit"]
    assert named and set(named) <= responses
    content = open(name, "rb").read()
    for broken in (content[: len(content) // 2], content[:200], b"", content[:300] + b"\0" * 50 + content[350:]):
        part = tmp_path / f"part-{len(broken)}-{broken[310:312].hex()}"
        part.mkdir()
        (part / "a.gz").write_bytes(broken)
        rows = warc.records(warc.read(spark, f"file://{part}")).collect()
        assert len(rows) <= pages.count() and sum(not r.intact for r in rows) <= 2
        if len(broken) == len(content) // 2:
            assert any(not r.intact for r in rows) and any(r.intact for r in rows)


def test_warc_query(spark, sf):
    got = {r.page_id: r for r in warc.op4_warc(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert got[r.page_id].payload_digest == hashlib.sha256(r.html.encode()).hexdigest() and got[r.page_id].intact


def plain_nearest(rows, k=5):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], np.float64)
    norm = np.sqrt((m * m).sum(axis=1))
    out = {}
    for at in np.flatnonzero(ids % 50 == 0):
        score = (m * m[at]).sum(axis=1) / (norm * norm[at])
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[at]][:k]
        out[int(ids[at])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def test_ann_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = plain_nearest(rows), defaultdict(list)
    for r in ann.op5_permutation_index(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    for q, found in got.items():
        exact = dict(want[q])
        assert all(s == pytest.approx(exact[i], abs=1e-12) for i, s in found if i in exact)


def test_ann_recall_in_a_full_block(spark):
    # drawn from the given vectors' means and covariances; 1,024 of 65,536 rows are reranked
    given_rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    rng, drawn = np.random.default_rng(0), []
    for label in sorted({r.label for r in given_rows}):
        m = np.array([r.embedding for r in given_rows if r.label == label])
        drawn.append(rng.multivariate_normal(m.mean(axis=0), np.cov(m.T), math.ceil(ann.BLOCK * len(m) / len(given_rows))))
    m = rng.permutation(np.concatenate(drawn))[: ann.BLOCK]
    pivots = ann._unit(m[rng.choice(len(m), 256, replace=False)])
    defaults = {k: p.default for k, p in inspect.signature(ann.search).parameters.items()}
    length, depth = defaults["length"], defaults["depth"]
    index = ann.Block(np.arange(len(m)), m, pivots, length, 6)
    norm, asked, hits = np.sqrt((m * m).sum(axis=1)), range(0, len(m), 331), 0
    for at, perm in zip(asked, ann.permutations(m[asked], pivots, length)):
        score = m @ m[at] / norm
        score[at] = -np.inf
        hits += len(set(np.argpartition(-score, 5)[:5].tolist()) & set(index.nearest(at, m[at], perm, 5, depth)[0].tolist()))
    assert depth * 50 < len(m) and hits / (5 * len(asked)) >= 0.9


@pytest.mark.parametrize("n", [2000, 20_000, 65_536])
def test_ann_recall_and_work_by_size(spark, n):
    """With the query's own pivots and parameters: recall, and the postings and rows that a query reads, against a scan's."""
    given_rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    rng, drawn = np.random.default_rng(1), []
    for label in sorted({r.label for r in given_rows}):
        m = np.array([r.embedding for r in given_rows if r.label == label])
        drawn.append(rng.multivariate_normal(m.mean(axis=0), np.cov(m.T), math.ceil(n * len(m) / len(given_rows))))
    m = rng.permutation(np.concatenate(drawn))[:n]
    d = {k: p.default for k, p in inspect.signature(ann.search).parameters.items()}
    some = spark.createDataFrame(pa.table({"v": pa.array(m[: d["sample"]].tolist(), pa.list_(pa.float64()))}))
    pivots, _ = ann.choose_pivots(some, d["n_pivots"], d["sample"], "v")
    index = ann.Block(np.arange(n), m, pivots, min(d["length"], len(pivots)), 6)
    norm, asked, hits, read = np.sqrt((m * m).sum(axis=1)), range(0, n, max(1, n // 150)), 0, 0
    for at, perm in zip(asked, ann.permutations(m[asked], pivots, d["read"])):
        score = m @ m[at] / norm
        score[at] = -np.inf
        hits += len(set(np.argpartition(-score, 5)[:5].tolist()) & set(index.nearest(at, m[at], perm, 5, d["depth"])[0].tolist()))
        read += sum(index.starts[p + 1] - index.starts[p] for p in perm.tolist())
    assert hits / (5 * len(asked)) >= 0.9
    if n == ann.BLOCK:
        assert read / len(asked) + d["depth"] * m.shape[1] < 0.06 * m.size  # of the numbers that a scan multiplies
    exact = index.nearest(7, m[7], perm, 5, n)[0].tolist()
    score = m @ m[7] / norm
    score[7] = -np.inf
    assert exact == np.argsort(-score)[:5].tolist()


def test_ann_on_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], "x"), (50, [0.0, 0.0], "x"), (1, None, "x"), (2, [1.0, None], "x"), (3, [float("nan"), 1.0], "x"), (4, [1.0], "x"), (5, [1.0, 0.0], "x"), (6, [2.0, 0.0], "x"), (7, [0.0, 1.0], "x"), (None, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = ann.search(df, df.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 5), (0, 6), (0, 7)] and got[0].score == 1.0
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = ann.search(copies, copies.where("vec_id = 100"), block=70).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    # several blocks of queries and of rows, all rows reranked: brute force
    v = np.random.default_rng(3).normal(size=(230, 4))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, df, k=3, block=60).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = unit @ unit.T - 2 * np.eye(len(v))
    assert dict(got) == {i: np.argsort(-near[i])[:3].tolist() for i in range(len(v))}


def test_ann_with_repeated_ids(spark):
    # every row twice; then two vectors under one id
    v = [(i, [float(i % 7 + 1), float(i % 5), float(i)]) for i in range(60)]
    once = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    twice = once.union(once)
    of = lambda df: sorted(map(tuple, ann.search(df, df.where("vec_id % 50 = 0")).collect()))
    assert of(twice) == of(once)
    two = spark.createDataFrame([*v, (50, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = ann.search(two, two.where("vec_id = 50")).collect()
    assert Counter((r.query_id, r["rank"]) for r in got) == {(50, k): 2 for k in range(1, 6)}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 4096), st.integers(1, 40), max_size=60))
def test_plan_places_every_piece(counts):
    runs = packing.plan(counts)
    used, fill = Counter(), defaultdict(list)
    for length, rank, n, first, offset in runs.tolist():
        assert rank == used[length]
        used[length] += n
        for s in range(first, first + n):
            fill[s].append((offset, length))
    assert used == Counter(counts)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def best_fit_decreasing(lengths, capacity=4096):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else capacity
        n += room == capacity
        insort(rooms, room - x)
    return n


@pytest.mark.parametrize("kind", range(4))
def test_plan_is_no_worse_than_best_fit_decreasing(kind):
    rng = np.random.default_rng(kind)
    draw = (lambda: rng.integers(1, 4097, 20_000), lambda: np.clip(rng.lognormal(6.5, 1, 20_000), 1, 4096), lambda: rng.integers(1000, 3000, 20_000), lambda: rng.integers(1200, 1500, 20_000))
    lengths = draw[kind]().astype(int).tolist()
    runs = packing.plan(dict(Counter(lengths)))
    assert (runs[:, 3] + runs[:, 2]).max() <= best_fit_decreasing(lengths)


def test_packing_query(spark, sf):
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    rows = packing.op8_best_fit_packing(spark, sf).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(by[r.doc_id], key=lambda x: x.piece)
        assert [(p.start, p.length) for p in parts] == [(a, min(4096, len(ids) - a)) for a in range(0, len(ids), 4096)]
        assert [p.ids_crc32 for p in parts] == [zlib.crc32(ids[a : a + 4096].tobytes()) for a in range(0, len(ids), 4096)]
    full = defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)][:-1]]).tolist()
    assert max(sum(n for _, n in p) for p in full.values()) <= 4096
    assert len(full) <= math.ceil(sum(r.length for r in rows) / 4096) * 1.02 + 1


def test_packing_of_odd_rows(odd, empty):
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    one = packing.tokenizer(packing.VOCABULARY)
    for r in odd.collect():
        assert np.frombuffer(one.encode(r.text), "<u4").tolist() == tokenizer.encode(r.text or "", add_special_tokens=False).ids
    rows = packing.pack(packing.tokenise(odd, keep_ids=True)).collect()
    assert sum(r.doc_id == 10 for r in rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(packing.tokenise(empty)).count() == 0


def test_word_ids_of_slices(monkeypatch):
    tokenizer, one = Tokenizer.from_file(packing.VOCABULARY), packing.WordTokenizer(packing.VOCABULARY, 20_000)
    texts = ["", None, " \t", "Ab  ab\x0b\x0cAB,\x85ab\x1cc\n", "<|endoftext|> A <|x", "É é é Σς ΑΣ", "x" * 5000, "a b " * 4000, *(f"w{i} {i}, É{i}é" for i in range(500))]
    for size in (1, 50, 4 << 20):
        monkeypatch.setattr(packing, "SLICE", size)
        for kind in (pa.string(), pa.large_string()):
            got = list(one.encode_all(pa.array(["cut off", *texts], kind).slice(1)))
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(one.encode_all(pa.array([], pa.string()))) == [] and list(one.encode_all(pa.array([None], pa.string()))) == [b""]



WORDS = ["KENDİSİ", "BELEDİYESİ", "İ", "Straße", "ŁÓDŹ", "ΟΔΟΣ", "naïve", "Ça", "日本", "word", "Word", "x1", "e\u0301", "ŉ", "ǅ", "ﬁ", "I", "İİ"]
MARKS = ["", ",", ".", "!?", "'", "...", "-", "\u0307", "#"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from(MARKS)).map("".join), max_size=6).map(" ".join), min_size=1, max_size=8))
def test_packing_ids_in_any_order_of_texts(texts):
    """What a worker remembers of the texts before, words bare or with marks, changes no ids."""
    texts = [*texts, "KENDİSİ", "KENDİSİ,", "BELEDİYESİ dedi. BELEDİYESİ, yeni"]
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    want = {t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts}
    one = packing.tokenizer(packing.VOCABULARY)
    for order in (texts, texts[::-1], sorted(texts), texts[::2] + texts[1::2]):
        one.memory = packing.Recent(100_000)
        for part in ([order], [[t] for t in order]):
            for some in part:
                assert list(one.encode_all(pa.array(some))) == [want[t] for t in some]


def test_packing_of_a_length_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    df = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 3 = 0, 700L, id % 90 + 1) as length")
    rows = packing.pack(df).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 3000
    full = defaultdict(list)
    for r in rows:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)][:-1]]).tolist()
        assert sum(n for _, n in parts) <= 4096


def plain_scores(docs, corpus=None):
    """By the counts of corpus; without one by those of the other documents."""
    words = lambda t: WORD.findall(lower(t))

    def counts(texts):
        one, two = Counter(), Counter()
        for t in texts:
            w = words(t)
            one.update([None, *w] if w else [])
            two.update(zip([None, *w], w))
        return one, two, sum(len(words(t)) for t in texts)

    one, two, total = counts(docs if corpus is None else corpus)
    out = []
    for t in docs:
        mine, pairs, n = counts([t]) if corpus is None else (Counter(), Counter(), 0)
        pairs_of = zip([None, *words(t)], words(t))
        share = lambda p: (two[p] - pairs[p]) / (one[p[0]] - mine[p[0]]) if two[p] > pairs[p] else 0.4 * max(1, one[p[1]] - mine[p[1]]) / max(1, total - n)
        out.append(sum(math.log(share(p)) for p in pairs_of))
    return out


def test_scores(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, plain_scores(list(texts.values()))))
    for r in ngram_lm.op9_stupid_backoff(spark, sf).collect():
        assert r.log_score == pytest.approx(want[r.doc_id]) and r.n_words == len(WORD.findall(texts[r.doc_id]))
    # words and pairs that the corpus lacks, parts of a few documents
    got = Counter((r.doc_id, round(r.log_score, 6)) for r in ngram_lm.score(odd, docs, part=10_000, buckets=5).collect())
    rows = odd.collect()
    assert got == Counter((r.doc_id, round(s, 6)) for r, s in zip(rows, plain_scores([r.text for r in rows], texts.values())))
    # nonsense that no other document holds scores below prose, though it's all known to itself; a copy makes a text likely
    some = [t for t in texts.values() if len(t.split()) > 100][:40]
    rows = [(0, " ".join(f"zq{i}x" for i in range(200))), *[(i + 1, t) for i, t in enumerate([*some, some[0]])]]
    means = {r.doc_id: r.mean_log_score for r in ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert means[0] < np.median(list(means.values())) < means[1] == means[41] == max(means.values())
    assert ngram_lm.score(empty).count() == 0 and ngram_lm.score(odd, empty).count() == odd.count()
    assert odd.where(F.col("text").isNull()).count() == 1


def foreign(kind, block, *fields):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{len(block):032x}>", *fields, f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """uuid ids, records that aren't responses, digests and numbers of other kinds, headers without a space: rows, never a failed job."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    bodies = [b"<p>hello</p>" * 9, b"", b"x"]
    made = [
        foreign("warcinfo", b"software: other/1.0\r\n"), foreign("request", b"GET / HTTP/1.1\r\nHost: a.example\r\n\r\n"),
        foreign("response", http + bodies[0], "WARC-Target-URI: http://a.example/", "WARC-Payload-Digest: sha1:2WAXX5NUWNNCS2BDKCO5OVDQBJVNKIVV"),
        foreign("metadata", b"fetchTimeMs: 1"), foreign("response", http + bodies[1], "WARC-Segment-Number: one", "X-Payload-Length: many"),
        foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <urn:uuid:1>", "WARC-Payload-Digest: md5:1"), foreign("response", http + bodies[2] + b"y" * 3, "X-Payload-Length: 99999999999999999999999999"),
        foreign("conversion", b"z"), foreign("resource", b"zz"), foreign("response", b"no http", "WARC-Record-ID:<urn:page:12x>"),
    ]
    import gzip

    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in made))
    rows = warc.records(warc.read(spark, f"file://{tmp_path}")).collect()
    assert len(rows) == 5 and all(r.page_id is None and r.refers_to is None and r.intact is None for r in rows)
    got = {r.record_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in rows}
    size = len(http)
    uuid = lambda n: f"<urn:uuid:{n:032x}>"
    told = lambda b: (len(b), hashlib.sha256(b).hexdigest(), "response")
    assert got == {uuid(size + 108): told(bodies[0]), uuid(size): told(b""), uuid(19): (None, None, "revisit"), uuid(size + 4): told(b"xyyy"), "<urn:page:12x>": told(b"")}
