"""Ranked search against scoring every document, over small blocks, several sets of queries, ties and odd rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dialoom.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(docs, items, best=20):
    """item -> [(rank, doc_id, score)] over rows (doc_id, text) and (item_id, text)."""
    tf = [(i, Counter(terms(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in tf]
    n_docs, n_terms = sum(x > 0 for x in n), sum(n)
    df = Counter(w for _, c in tf for w in c)
    out = {}
    for item, text in set(items):
        asked = [w for w in terms(text) if df[w]]
        scored = []
        for (doc, c), length in zip(tf, n):
            m = 75 + (25 * length * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w in asked if c[w])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out[item, text] = [(k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:best], 1)]
    return out


def same(spark, docs, items, best=20, **kinds):
    got = lexical.search(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, rank string, query int"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int"), best)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = Counter((item, *r) for (item, _), rows in plain_search(docs, items, best).items() for r in rows)
    assert Counter(map(tuple, got.collect())) == want
    return want


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = Counter((item, *r) for (item, _), rows in plain_search(docs, items).items() for r in rows)
    assert Counter(map(tuple, lexical.op12_lexical_search(spark, sf).collect())) == want


@pytest.mark.parametrize("sizes", [(3, 2, 1 << 15), (7, 64, 20), (256, 64, 1)])
def test_odd_rows_in_blocks_and_sets(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "GROUP", "TERMS"), sizes):
        monkeypatch.setattr(lexical, name, size)
    rng = np.random.default_rng(5)
    vocabulary = ["alpha", "Beta", "x1", "été", "ÉTÉ", "日本", "the", "THE", "2024", "İx", "a_b", "c-d", "naïve\x7f", "ß"]
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=np.arange(14, 0, -1) / 105))
    docs = [(i if i % 9 else None, text(int(rng.integers(0, 30)))) for i in range(120)]
    docs += [(500, "the the the beta"), (500, "the the the beta"), (501, None), (502, ""), (503, " .!? "), (504, "beta " * 30_000), (505, "rare İx")] + [(600 + i, "copies of beta and x1") for i in range(50)]
    docs += docs[:10]
    items = [(1, "the beta"), (1, "x1"), (2, "the the THE Beta absent"), (2, "the the THE Beta absent"), (3, None), (4, ""), (5, "absent"), (None, "rare été ÉTÉ"), (6, "copies"), (7, "c d a b naïve"), (8, " ".join(vocabulary) * 3)]
    assert same(spark, docs, items)
    same(spark, docs, items, best=1)


def test_empty_tables(spark):
    assert not same(spark, [], [(1, "a")])
    assert not same(spark, [(1, "a")], [])
    assert not same(spark, [(1, ""), (2, None)], [(1, "a")])
    assert same(spark, [(1, "a")], [(1, "a")]) == Counter({(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 1200))): 1})


def blocks_of(docs, asked, size):
    """The blocks of an index, made by hand."""
    out = []
    for at in range(0, len(docs), size):
        part = docs[at : at + size]
        entries = sorted((asked.terms[w.encode()], p, n) for p, (_, t) in enumerate(part) for w, n in Counter(terms(t)).items() if w.encode() in asked.terms)
        held, holders = np.unique([e[0] for e in entries], return_counts=True)
        columns = {"block": [at], "ids": [[d for d, _ in part]], "lengths": [[len(terms(t)) for _, t in part]], "terms": [held.astype(int).tolist()], "holders": [holders.tolist()], "places": [[e[1] for e in entries]], "times": [[e[2] for e in entries]]}
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 5]
        out += lexical._rows(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns.values(), kinds)], list(columns)))
    return out


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(["the"] * int(rng.integers(1, 40)) + ["of"] * int(rng.integers(1, 20)) + [f"w{i // 40}"] * (i % 40 < 3))) for i in range(2000)]
    items = spark.createDataFrame([(k, f"the of w{k} w{k}") for k in range(10)], "item_id long, text string")
    asked = lexical.Asked(lexical.asked_terms(items).collect())
    n, holders = [len(terms(t)) for _, t in docs], defaultdict(int)
    for _, t in docs:
        for w in set(terms(t)) & {x.decode() for x in asked.terms}:
            holders[asked.terms[w.encode()]] += 1
    scorer = lexical._Scorer(asked, len(docs), sum(n), holders, 3)
    rows = blocks_of(docs, asked, 20)
    every = np.arange(len(asked.items))
    for row in rows:
        bounds = scorer.bounds(row)
        for q, scores in scorer.scores(row, every):
            assert scores.max(initial=0) <= bounds[q]
    places = lexical._Places(scorer)
    scored = lexical.score_group(rows, scorer, places)
    assert scored < 0.1 * len(rows) * len(every)  # the rare term's few blocks, then the bounds are too small
    want = plain_search(docs, [(k, f"the of w{k} w{k}") for k in range(10)], 3)
    got = {q: places.sorted(q) for q in places.held}
    for q, item in asked.item_ids():
        assert [(int(d), int(s)) for s, _, d in got[q].T] == [(d, s) for _, d, s in want[item, f"the of w{item} w{item}"]]


def test_slices_of_a_long_text(monkeypatch):
    text = ("Some words, été 日本 x" * 500).encode()
    monkeypatch.setattr(lexical, "SLICE", 64)
    assert [w for some in lexical.terms_of(text) for w in some] == [w.encode() for w in terms(text.decode())]
