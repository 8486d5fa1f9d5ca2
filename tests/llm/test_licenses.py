"""License scans against a plain search, on edited notices, odd rows and odd letters."""

import re

import pytest
from pyspark.sql import functions as F

from dialoom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_places(text):
    """Place and label of each phrase."""
    own = plain_words(text)
    return sorted((i, label) for label, phrase in licenses.PHRASES for p in [phrase.split()] for i in range(len(own)) if own[i : i + len(p)] == p)


def check(df, got):
    want = []
    for r in df.collect():
        at = plain_places(r.text)
        want.append((r.doc_id, len(plain_words(r.text)), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(want, key=key) == sorted([tuple(r)[:6] for r in got], key=key)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 and (r.n_base == 0 or r.score == 1)


def test_base_places(spark, sf, documents):
    check(documents, licenses.op13_license_scan(spark, sf).collect())


def test_odd_rows(spark, odd, empty):
    check(odd, licenses.scan(odd).collect())
    assert licenses.scan(empty).count() == 0
    texts = [
        "MIT License mit  license; MIT-license (c) CC BY cc by cc by", "GNU general GNU General Public License v3, gnu\tGENERAL\npublic license gnu general public", "mit", "license", "cc", "by", "MIT",
        "lİcense mit lİcense", "apache licenſe MIT LICENſE", "mit Kicense K", "mit license mit　license", "mit\x00license mit_license mit`license", "2mit license mit license2", "GNU é general public license",
        "apache license " * 3000, "cc " * 3 + "by", None, "", " ",
    ]
    df = spark.createDataFrame([(i % 5 if i % 4 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, label string, votes int")
    check(df, licenses.scan(df).collect())
    check(df.union(df), licenses.scan(df.union(df)).collect())


def label_of(spark, text, **kw):
    return licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), **kw).first()


@pytest.mark.parametrize("at", range(len(licenses.TEXTS)))
def test_whole_notices(spark, at):
    label, text = licenses.TEXTS[at]
    r = label_of(spark, "some words before " + text.upper() + " and after")
    assert label in r.labels.split(",") and r.score == 1.0 and r.n_spans >= 1


def test_edited_notices(spark):
    text = dict(licenses.TEXTS)["bsd"]
    words = text.split()
    r = label_of(spark, " ".join(words[:8] + ["really"] + words[8:15] + words[16:]))
    assert r.labels == "bsd" and 0.5 <= r.score < 1  # diagonals 0, 1 and 0 again are one span
    r = label_of(spark, " ".join(words[:6]))
    assert r.labels == "" and 0 < r.score < 0.5
    # two halves far apart lie on diagonals that are no neighbours
    r = label_of(spark, " ".join(words[:10] + ["x"] * 50 + words[10:]))
    assert r.labels == "" and r.n_spans == 0
    # two copies are two spans
    assert label_of(spark, f"{text} between {text}").n_spans == 2


def test_own_templates(spark):
    r = label_of(spark, "All Rights Reserved by us. Do what you like with this work of ours, please.", phrases=(("arr", "all rights reserved"),), texts=(("dwyl", "do what you like with this work"),))
    assert (r.base_labels, r.labels, r.first_word, r.n_base) == ("arr", "arr,dwyl", 0, 1)


def test_native_plan(spark, sf):
    plan = licenses.op13_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Pandas|Arrow", plan)
    # texts aren't shuffled: what is dealt out holds numbers and labels
    assert all("text" not in x and "gram#" not in x for x in re.findall(r"Exchange hashpartitioning\([^)]*\)", plan))


def test_many_documents_share_a_line(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("words and more "), F.col("id").cast("string"), F.lit(" released under the MIT License")).alias("text"))
    r = licenses.scan(df).groupBy("n_base", "labels").count().collect()
    assert [tuple(x) for x in r] == [(1, "mit", 2000)]
