"""SimHash near-duplicates by vantage-point trees.

Documents with one fingerprint are one class, so only distinct fingerprints are compared. A tree built on a
bounded sample cuts them into shards by their Hamming distance to vantage points; a fingerprint that by the
triangle bound may have a partner beyond a cut visits the shard there too. Each shard searches with trees of its
own and gives links that connect what is near, no more than it has fingerprints; components do the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, each, table
from .components import components

RADIUS = 2
WORDS = 3
SEED = 42
#: Hashes that are counted at once, so that a long text takes no more memory.
_PIECE = 1 << 16


def fingerprint_text(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included, as a signed number; zero without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # lower() of bytes changes A-Z alone
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - WORDS + 1)
    starts, stops = np.append(0, ends[:-1])[:n].tolist(), (ends[-n:] - 1).tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _PIECE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + _PIECE], stops[at : at + _PIECE])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The signed 64-bit fingerprint of a text column; zero for null and empty texts."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array(map(fingerprint_text, each(texts)), pa.int64())

    return F.arrow_udf(of, "bigint")(text)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, leaves: int) -> list[tuple[np.uint64, int]]:
    """A complete vantage-point tree over a sample, as a heap of (vantage point, cut): at most cut goes left.

    The vantage point is the one of a few that cuts the sample most evenly with the fewest near the cut.
    """
    tree: list[tuple[np.uint64, int]] = []
    level = [sample]
    while len(level) < leaves:
        below = []
        for part in level:
            best = (np.inf, np.uint64(0), 32, part, part)
            for point in part[:: max(1, len(part) // 6)][:6]:
                d = _distance(part, point)
                count = np.bincount(d, minlength=66)
                left = np.cumsum(count)
                for at in np.flatnonzero((left > 0.35 * len(part)) & (left < 0.75 * len(part))):
                    cost = max(left[at], len(part) - left[at] + count[max(0, at - RADIUS + 1) : at + 1].sum())
                    if cost < best[0]:
                        best = (cost, point, int(at), part[d <= at], part[d > at - RADIUS])
            tree.append((best[1], best[2]))
            below += best[3:]
        level = below
    return tree


def route(prints: np.ndarray, tree: list[tuple[np.uint64, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, fingerprints that belong or must visit there).

    Of two fingerprints within RADIUS on both sides of a cut, the inner one is at more than cut - RADIUS from the
    vantage point, by the triangle inequality; so it is enough that the inner ones visit the outer side.
    """
    parts = [(0, prints)]
    while parts:
        node, part = parts.pop()
        if node >= len(tree):
            if len(part):
                yield node - len(tree), part
            continue
        point, at = tree[node]
        d = _distance(part, point)
        parts += [(2 * node + 1, part[d <= at]), (2 * node + 2, part[d > at - RADIUS])]


def near_links(prints: np.ndarray, leaf: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links within distinct fingerprints that connect whatever is connected at RADIUS, fewer than there are prints."""
    prints = np.unique(prints)
    parent = np.arange(len(prints))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    todo = [np.arange(len(prints))]
    while todo:
        part = todo.pop()
        if len(part) > leaf:  # cut again, if that helps
            mine = prints[part]
            for point in mine[:: len(mine) // 4][:4]:
                d = _distance(mine, point)
                at = int(np.median(d))
                inner, outer = part[d <= at], part[d > at - RADIUS]
                if max(len(inner), len(outer)) < 0.9 * len(part):
                    todo += [inner, outer]
                    break
            else:
                inner = outer = None
            if inner is not None:
                continue
        for at in range(0, len(part), 512):
            block = part[at : at + 512]
            rest = part[at:]
            i, j = np.nonzero(_distance(prints[block][:, None], prints[rest][None, :]) <= RADIUS)
            near = i < j
            for x, y in zip(block[i[near]].tolist(), rest[j[near]].tolist()):
                a, b = root(x), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((x, y))
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return prints[pairs[:, 0]], prints[pairs[:, 1]]


def link_fingerprints(prints: DataFrame, shard: int = 4096, sample: int = 1 << 16, col: str = "fp") -> DataFrame:
    """a, b: links between distinct fingerprints that connect all pairs within RADIUS.

    shard: fingerprints wanted in a shard; the tree has at most sample / 16 shards, and larger shards are cut
    again by trees of their own inside the task, which takes 8 bytes for each fingerprint. The sample, at most
    about as many fingerprints as it says, is all that reaches the driver.
    """
    spark = prints.sparkSession
    n = prints.count()
    leaves = 1 << max(0, int(np.ceil(np.log2(max(1, min(n / shard, sample / 16))))))
    chosen = prints.where(F.pmod(F.xxhash64(col, F.lit("tree")), F.lit(1 << 30)) < int((1 << 30) * min(1, sample / max(1, n)))) if leaves > 1 else prints.limit(0)
    got = np.sort(chosen.select(col).toArrow()[col].to_numpy().astype(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(build_tree(np.random.default_rng(5).permutation(got), leaves) if len(got) else [])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in route(batch.column(0).to_numpy().view(np.uint64), shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), at, np.int32)), pa.array(part.view(np.int64))], ["shard", "fp"])

    def search(part: pa.Table) -> pa.Table:
        a, b = near_links(part["fp"].to_numpy().view(np.uint64))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = prints.select(F.col(col).alias("fp")).mapInArrow(deal, "shard int, fp long")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """What near_duplicates gives, with root, which names a component even if it holds null ids alone, and columns of docs."""
    marked = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"), *[c.alias(n) for n, c in more.items()]), "fingerprints")
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(link_fingerprints(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root")
    return marked.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed) and component_id, the smallest doc_id reachable by links of RADIUS or fewer bits.

    Texts without a word, null ones included, have fingerprint zero and are linked like any other. A null id is
    kept; a component of null ids alone has a null component_id. Repeated rows stay repeated, other columns are
    ignored, and an empty table gives an empty result.
    """
    return near_groups(docs, id_col, text_col).select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
