"""Entities across slices, replacement in one pass, masking on a file's own row."""

import re
import time
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoom.operators import masking

NAME = re.compile(r"Dr [A-Z][a-z]*")


def names(text):
    return [(*m.span(), "PER") for m in NAME.finditer(text)]


PARTS = ["Dr Smith", "Smith", "X", "y" * 30, " ", "Dr Brown", "Dr B" + "o" * 90, ". ", "Dr . "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.integers(16, 50))
def test_slices_find_what_the_whole_has(text, size):
    got = masking.spans_of([text, None, text], names, size, 8, together=3)  # a name needs four characters to begin
    assert got == [names(text), [], names(text)]


@given(st.integers(0, 3000), st.integers(1, 60), st.integers(0, 70))
def test_windows_cover_every_place(length, size, overlap):
    at = 0
    for start, end in masking.windows(length, size, overlap):
        assert start <= max(0, at - min(overlap, size - 1)) and end - start <= size and end >= at
        at = end
    assert at == length


def test_name_at_a_cut(spark):
    text = "a" * 395 + "Dr Smith" + "b. Dr" + " Lee"
    rows = spark.createDataFrame([(1, "s", text), (None, "Dr Poe", text), (None, "Dr Poe", "Dr Roe\r\n\r\n Dr Ann"), (1, None, None)], "file_id long, stem string, text string")
    got = masking.mask(rows, names).collect()
    assert [r.text_out for r in got] == ["a" * 395 + "[NAME]. [NAME]"] * 2 + ["[NAME]\r\n\r\n [NAME]", None]
    assert [(r.stem_out, r.renamed, r.changed) for r in got] == [("s", False, True), ("[NAME]", True, True), ("[NAME]", True, True), (None, False, False)]
    plan = masking.mask(rows, names)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_many_spans_in_proportional_time():
    def took(n):
        text, spans = "ab cd " * n, [(6 * i, 6 * i + 2, "PER") for i in range(n)]
        began = time.perf_counter()
        out = masking.replaced(text, spans)
        assert out == "[NAME] cd " * n
        return time.perf_counter() - began

    took(1000)
    assert min(took(80_000) for _ in range(3)) < 16 * min(took(10_000) for _ in range(3)) + 0.05


def test_many_spans_of_a_column(spark):
    df = spark.createDataFrame([("ab cd " * 10_000, [(6 * i, 6 * i + 2, "PER") for i in range(10_000)]), (None, [(0, 1, "PER")]), ("x", None)], f"t string, s {masking.SPANS}")
    assert [r.x for r in df.select(masking.replace_spans(df.t, df.s).alias("x")).collect()] == ["[NAME] cd " * 10_000, None, "x"]


@given(st.lists(st.tuples(st.integers(-2, 12), st.integers(-2, 14), st.sampled_from(["PER", "B-ORG", "DATE", None])), max_size=8))
def test_resolved_is_a_union_of_intervals(spans):
    known = [(s, e) for s, e, label in spans if masking.kind_of(label) and 0 <= s < e <= 11]
    out = masking.resolved(spans, 11)
    assert {p for s, e, _ in out for p in range(s, e)} == {p for s, e in known for p in range(s, e)}
    assert all(a[1] <= b[0] for a, b in zip(out, out[1:]))


def make():
    made = []

    def batch(slices):
        made.append(len(slices))
        return [names(x) for x in slices]

    batch.made = made
    return batch


def test_detector_made_once_for_many_slices(spark):
    loaded = masking.Loaded(make)
    assert masking.spans_of(["Dr Ann"] * 100, loaded, together=40) == [[(0, 6, "PER")]] * 100
    assert masking.spans_of(["Dr Ann"], masking.Loaded(make)) == [[(0, 6, "PER")]]  # made already, by an equal key
    assert masking._MADE[loaded.key].made == [40, 40, 20, 1]
    df = spark.createDataFrame([("Dr Ann " * 200,)], "t string").select(masking.masked(F.col("t"), loaded).alias("t"))
    assert df.first().t == "[NAME] " * 200


@pytest.mark.parametrize("text", ["", " \n", "\r\n", " ", "x\x0b", "Dr A\x85Dr B\x1c"])
def test_line_ends_stay(text):
    assert masking.masked_lines([text], names, 400, 100) == [NAME.sub("[NAME]", text)]


def test_batches_are_bounded_by_bytes(spark):
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("ab cd "), 1000).alias("text"), F.lit("s").alias("stem"), F.col("id").alias("file_id"))  # 24 MB in one task
    for asked in (lambda: masking.mask(rows, names), lambda: masking.detect(F.col("text"), names), lambda: masking.masked(F.col("text"), names)):
        spark.conf.unset(masking._BATCH_KEY)
        asked()
        assert rows.select(F.arrow_udf(held, "long")("text").alias("n")).agg(F.max("n")).first()[0] < 1.1 * masking.BATCH_BYTES
    spark.conf.set(masking._BATCH_KEY, "1m")  # a session's own smaller bound stays
    masking.mask(rows, names)
    assert spark.conf.get(masking._BATCH_KEY) == "1m"
    spark.conf.unset(masking._BATCH_KEY)


def test_lines_without_entities_take_little():
    texts = ["a\n" * 50_000, "Dr Ann", None]
    tracemalloc.start()
    got = masking.spans_of(texts[0].split("\n") + texts[1:], names)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [[]] * 50_001 + [[(0, 6, "PER")], []] and most < 10e6
    runs = []
    out = masking._in_runs(pa.array(["x" * 300_000] * 10 + [None]), lambda some: runs.append(len(some)) or some, pa.string())
    assert max(runs) <= 4 and out.to_pylist() == ["x" * 300_000] * 10 + [None]
