"""Trees of files: true paths, bytes as they are, collisions, failed tasks, order and even partitions."""

import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoom.plans.queries import QUERIES
from dialoom.sources import files, sinks, trees


def on_disk(top):
    return {os.path.relpath(f"{d}/{n}", top): open(f"{d}/{n}", "rb").read() for d, _, names in os.walk(top) for n in names if not d.startswith(f"{top}/_") and n != "_SUCCESS" and not n.endswith(".crc")}


TEXTS = [("a/x/1[N].txt", "one\r\ntwo"), ("b/x/1[N].txt", "no end"), ("a/x/2[N].txt", "\n\n"), ("9 [NAME] 男 34岁.txt", "中文 x"), ("a b%20?*.txt", ""), ("deep/er/and/deeper.txt", None)]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "rel_path string, text string")


def test_paths_and_bytes(spark, texts, tmp_path):
    out = f"{tmp_path}/out"
    sinks.write_mirrored(texts, f"file://{out}")
    assert on_disk(out) == {p: (t or "").encode() for p, t in TEXTS}
    back = {r.rel_path: bytes(r.content) for r in trees.read(spark, f"file://{out}").collect()}
    assert back == on_disk(out)
    with pytest.raises(FileExistsError):
        sinks.write_mirrored(texts, out)
    sinks.write_mirrored(texts.limit(1), out, "overwrite")
    assert len(on_disk(out)) == 1
    raw = spark.createDataFrame([("bin", b"\xff\x00\n")], "rel_path string, content binary")
    trees.write(raw, out)
    assert on_disk(out)["bin"] == b"\xff\x00\n" and len(on_disk(out)) == 2
    with pytest.raises(Exception, match="FileExistsError"):  # nothing is written over, nor is anything moved then
        trees.write(raw.union(raw.select(F.lit("new"), "content")), out)
    assert len(on_disk(out)) == 2 and not [x for x in os.listdir(out) if x.startswith(trees.STAGING)]


def test_collisions_and_bad_paths(spark, texts, tmp_path):
    more = [("a/x/1[N].txt", "other"), ("../out.txt", "x"), ("a//b", "x"), ("", "x"), (None, "x"), ("a/./b", "x"), ("/abs", "x"), ("长" * 100, "x"), ("a/", "x"), (None, "y"), ("..a", "good")]
    with pytest.raises(sinks.Collisions, match="_collisions") as raised:
        sinks.write_mirrored(texts.union(spark.createDataFrame(more, texts.schema)), f"{tmp_path}/out")
    rows = {(r.rel_path, r.n, r.error) for r in raised.value.rows.collect()}
    assert rows == {("a/x/1[N].txt", 2, "collision"), (None, 2, "bad_path"), *((p, 1, "bad_path") for p in ("../out.txt", "a//b", "", "a/./b", "/abs", "长" * 100, "a/"))}
    assert on_disk(f"{tmp_path}/out") == {p: (t or "").encode() for p, t in [*TEXTS[1:], ("..a", "good")]}
    assert not os.path.exists(f"{tmp_path}/out.txt")


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), "id").alias("rel_path"), F.when(F.col("id") == 35, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="stop"):
        trees.write(rows, f"{tmp_path}/out")
    assert [x for _, _, names in os.walk(f"{tmp_path}/out") for x in names if not x.endswith(".crc")] == []


def test_empty(spark, texts, tmp_path):
    sinks.write_mirrored(texts.limit(0), f"{tmp_path}/out")
    assert trees.read(spark, f"{tmp_path}/out").count() == trees.read(spark, f"{tmp_path}/none").count() == 0


@given(st.lists(st.integers(0, 1 << 20), max_size=60), st.integers(1 << 16, 1 << 22))
def test_runs_are_even(sizes, most):
    runs = trees.packed(sizes, most)
    assert [i for a, b in runs for i in range(a, b)] == list(range(len(sizes))) and all(a < b for a, b in runs)
    largest = max(sizes, default=0) + trees.OPEN_COST
    total = sum(s + trees.OPEN_COST for s in sizes)
    assert all(sum(s + trees.OPEN_COST for s in sizes[a:b]) <= total / max(1, -(-total // most)) + largest for a, b in runs)


def test_order_filters_and_partitions(spark, tmp_path):
    for i in range(300):
        folder = tmp_path / f"d{i % 7}"
        folder.mkdir(exist_ok=True)
        (folder / f"{i:03}.{'txt' if i % 3 else 'md'}").write_bytes(b"x" * (i * 997 % 20_000))
    got = trees.read(spark, str(tmp_path), "*.txt", partition_bytes=2 << 20)
    rows = got.collect()
    want = sorted(f"{tmp_path}/d{i % 7}/{i:03}.txt" for i in range(300) if i % 3)
    assert [r.path for r in rows] == want and all(r.length == len(r.content) for r in rows)
    n = got.rdd.getNumPartitions()
    held = got.groupBy(F.spark_partition_id()).agg(F.sum(F.col("length") + trees.OPEN_COST).alias("b")).collect()
    assert n == len(held) > 4 and max(r.b for r in held) < 1.3 * min(r.b for r in held)
    assert [r.rel_path for r in trees.read(spark, str(tmp_path), "*.txt", "d3/").collect()] == sorted(f"d3/{i:03}.txt" for i in range(3, 300, 7) if i % 3)
    assert trees.read(spark, str(tmp_path), recursive=False).count() == 0
    assert {r.nth: r.path for r in files.numbered(got).collect()} == dict(enumerate(want, 1))
    roots = [f"{tmp_path}/d1", f"{tmp_path}/none", f"{tmp_path}/d0"]
    assert [r.rel_path for r in trees.read(spark, roots).limit(1).collect()] == ["000.md"]
    inside = files.text_files(spark, roots, in_order=True).select(files.within(F.col("path"), roots).alias("p")).collect()
    assert [r.p for r in inside] == sorted(f"d{i % 7}/{i:03}.txt" for i in range(300) if i % 7 < 2 and i % 3)
    plain = files.text_files(spark, roots)
    assert sorted(r.p for r in plain.select(files.within(F.col("path"), roots).alias("p")).collect()) == [r.p for r in inside]
    assert "/" not in files.text_files(spark, roots[:1]).select(files.within(F.col("path"), roots[:1]).alias("p")).first().p


def test_tasks_move_files(spark, tmp_path, monkeypatch):
    seen, dealt = [], trees._by_tasks

    def by_tasks(spark, path, manifests, act):
        seen.append((act.__name__, len(manifests), len([x for x in os.listdir(path) if not x.startswith(trees.STAGING)])))
        dealt(spark, path, manifests, act)
        if act is trees.place:  # a task that is run again finds its files moved
            dealt(spark, path, manifests, act)

    monkeypatch.setattr(trees, "_by_tasks", by_tasks)
    rows = spark.range(0, 60, 1, 3).select(F.format_string("d%d/%02d.txt", F.col("id") % 4, "id").alias("rel_path"), F.col("id").cast("string").cast("binary").alias("content"))
    trees.write(rows, f"{tmp_path}/out")
    assert seen == [("look", 3, 0), ("place", 3, 0)]
    assert on_disk(f"{tmp_path}/out") == {f"d{i % 4}/{i:02}.txt": str(i).encode() for i in range(60)} and not [x for x in os.listdir(f"{tmp_path}/out") if x.startswith(trees.STAGING)]


def test_manifests_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "MOVES", 7)
    monkeypatch.setattr(trees, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(taskAttemptId=lambda: 5)))
    batch = pa.RecordBatch.from_pydict({"rel_path": [f"d/{i}" for i in range(21)], "content": [b"%d" % i for i in range(21)]})
    writer = trees.TreeWriter(f"{tmp_path}/out", False)
    staged = writer.write(iter([batch, batch.slice(0, 0)]))
    assert [os.path.basename(m) for m in staged.manifests] == ["manifest-0", "manifest-7", "manifest-14"]
    writer.commit([staged, None])
    assert on_disk(f"{tmp_path}/out") == {f"d/{i}": b"%d" % i for i in range(21)} and sorted(os.listdir(f"{tmp_path}/out")) == ["_SUCCESS", "d"]


def test_numbers_come_with_the_listing(spark, tmp_path):
    for i in range(150):
        (tmp_path / f"{i * 7919 % 1000:03}.{'txt' if i % 3 else 'md'}").write_bytes(b"x" * i)
    got = trees.read(spark, str(tmp_path), "*.txt", partition_bytes=1 << 20, numbered=True)
    assert got.rdd.getNumPartitions() > 4
    assert {r.nth: r.path for r in got.collect()} == {r.nth: r.path for r in files.numbered(got.drop("nth")).collect()}
    plan = QUERIES["files_in_path_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Exchange" not in plan
