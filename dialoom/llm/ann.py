"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Rows are indexed in blocks: in each block a pivot's inverted
file holds the rows that have it among their nearest, with its place there. A query reads the files of its own nearest
pivots and no others, which gives the footrule distance, as far as these tell, to every row that shares one; the
nearest by footrule, ties included, are reranked by exact cosine. With many pivots files are short: a query reads a few
postings for each row of a block, where a scan reads whole vectors. Queries are cut into blocks too, and a task gets one
block of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Vectors in a block of the index, and in a block of queries.
BLOCK = 1 << 16
#: Queries of a block that are taken at once.
QUERIES = 1 << 11


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the vectors that take part, and which they are: of length dim, finite, not zero."""
    sizes = np.array([len(v) if v is not None and v.is_valid else -1 for v in vectors]) if vectors.null_count else np.diff(vectors.offsets.to_numpy())
    ok = np.flatnonzero(sizes == dim)
    flat = vectors.take(pa.array(ok)).flatten().cast(pa.float64())
    m = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(ok), dim)
    good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    return m[good], ok[good]


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return (m / np.sqrt((m * m).sum(axis=1, keepdims=True))).astype(np.float32)


def permutations(m: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    out = np.empty((len(m), length), np.int32)
    for at in range(0, len(m), 8192):
        near = _unit(m[at : at + 8192]) @ pivots.T
        top = np.argpartition(-near, length - 1, axis=1)[:, :length]
        out[at : at + 8192] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
    return out


class Block:
    """The inverted files of one block: for each pivot the rows that it is near to and what it saves them. Copies of a vector are one row."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, pivots: np.ndarray, length: int, keep: int) -> None:
        order = np.lexsort((ids, *m.T[::-1]))
        ids, m = ids[order], m[order]
        first = np.append(True, (m[1:] != m[:-1]).any(axis=1)) if len(m) else np.zeros(0, bool)
        once = first | np.append(True, ids[1:] != ids[:-1])[: len(ids)]  # a row that is repeated whole counts once
        ids, m, first = ids[once], m[once], first[once]
        starts = np.flatnonzero(first)
        self.rows = m[starts]
        ends = np.append(starts[1:], len(m))
        self.ids = [ids[s : min(e, s + keep)] for s, e in zip(starts, ends)]  # the smallest ids of each vector suffice
        self.norms = np.sqrt((self.rows * self.rows).sum(axis=1))
        self.pivots, self.length = pivots, length
        near = permutations(self.rows, pivots, length).ravel()
        posted = np.argsort(near, kind="stable")
        self.posted = (posted // length).astype(np.int32)
        self.saves = (length - posted % length).astype(np.uint16)
        self.starts = np.searchsorted(near[posted], np.arange(len(pivots) + 1)).tolist()

    def totals(self, perm: np.ndarray) -> np.ndarray:
        """What each row's footrule distance falls short of the most there is, by the pivots of a query: each that it shares saves the length less the later place."""
        parts = [(self.starts[p], self.starts[p + 1]) for p in perm.tolist()]
        rows = np.concatenate([self.posted[a:b] for a, b in parts])
        saved = np.concatenate([np.minimum(self.saves[a:b], self.length - place) for place, (a, b) in enumerate(parts)])
        return np.bincount(rows, saved, len(self.rows))

    def nearest(self, query_id: int, q: np.ndarray, perm: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and cosines of the k nearest of those that footrule ranks first."""
        if not len(self.rows):
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self.rows) > depth:
            total = self.totals(perm)
            least = np.partition(total, len(total) - depth)[len(total) - depth]
            near = np.flatnonzero(total >= least) if least > 0 else np.union1d(np.flatnonzero(total), np.arange(depth))
        else:
            near = np.arange(len(self.rows))
        cosine = (self.rows[near] * q).sum(axis=1) / (self.norms[near] * np.sqrt((q * q).sum()))
        if len(near) > 4 * k:
            cut = np.partition(-cosine, 2 * k)[2 * k]
            near, cosine = near[-cosine <= cut], cosine[-cosine <= cut]
        ids = np.concatenate([self.ids[i] for i in near])
        score = np.repeat(cosine, [len(self.ids[i]) for i in near])
        own = np.repeat((self.rows[near] == q).all(axis=1), [len(self.ids[i]) for i in near])
        other = (ids != query_id) | ~own
        ids, score = ids[other], score[other]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def choose_pivots(vectors: DataFrame, n_pivots: int, sample: int, vec_col: str) -> tuple[np.ndarray, int]:
    """Unit pivots far from each other, from at most about sample vectors chosen by a hash of the vector, and the dimension.

    The dimension is the commonest length (the smallest on a tie). Only the sample reaches the driver.
    """
    v = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).select(F.col(vec_col).alias("v"))
    sizes = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return np.zeros((0, 0), np.float32), 0
    dim, n = sizes[0].dim, sizes[0].n
    share = F.pmod(F.xxhash64("v", F.lit("pivot")), F.lit(1 << 30)) < int((1 << 30) * min(1, sample / n))
    got = v.where((F.size("v") == dim) & share).distinct().limit(2 * sample).toArrow()["v"].combine_chunks()
    m, _ = _matrix(got, dim) if len(got) else (np.zeros((0, dim)), None)
    if not len(m):
        got = v.where(F.size("v") == dim).distinct().limit(sample).toArrow()["v"].combine_chunks()
        m, _ = _matrix(got, dim)
    if not len(m):
        return np.zeros((0, dim), np.float32), dim
    m = _unit(m[np.lexsort(m.T[::-1])])
    picked, far = [0], np.full(len(m), np.inf)
    while len(picked) < min(n_pivots, len(m)):
        # of a few random rows the one that is farthest from the pivots so far: apart, but not outliers alone
        far = np.minimum(far, 1 - m @ m[picked[-1]])
        some = np.random.default_rng(len(picked)).choice(len(m), min(len(m), 8), replace=False)
        far[picked] = -1
        picked.append(int(some[np.argmax(far[some])]) if far[some].max() > -1 else int(np.argmax(far)))
    return m[picked], dim


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, n_pivots: int = 2048, length: int = 64, depth: int = 1024, read: int = 48, sample: int = 20_000, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of vectors, its own row left out.

    length: nearest pivots that a row is posted under; read: those whose files a query reads. depth: distinct rows of a
    block that are reranked, besides those that tie with the last. The search is exact with a depth of block, as then all
    rows are reranked, and so it is in a block of no more rows than depth, for which no file is read. Vectors that are
    null, zero, of another length than the commonest, or hold null or non-finite components take no part.
    Ties go to the smaller vec_id. A row that is repeated whole counts once, as a query and as a candidate; rows that
    share a vec_id but not the vector are queries and candidates of their own, and a query leaves out its own row alone.
    Other columns are ignored.
    A task holds one block of the index and one block of queries, so that neither grows with the tables.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col(id_col).isNotNull())
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col(id_col).isNotNull())
    pivots, dim = choose_pivots(rows, n_pivots, sample, "v")
    length = min(length, len(pivots))
    shared = spark.sparkContext.broadcast(pivots)
    n_rows, n_asked = (max(1, -(-df.count() // block)) for df in (rows, asked))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocked = rows.select("id", "v", dealt(n_rows).alias("b"), every(n_asked).alias("q"))
    sent = asked.select("id", "v", every(n_rows).alias("b"), dealt(n_asked).alias("q"))

    def of(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if length and len(mine) and len(theirs):
            vectors_in = lambda t: _matrix(t["v"].combine_chunks(), dim)
            m, which = vectors_in(mine)
            index = Block(mine["id"].to_numpy()[which], m, shared.value, length, k + 1)
            seen: set[tuple[int, bytes]] = set()
            for at in range(0, len(theirs), QUERIES):
                part = theirs.slice(at, QUERIES)
                q, which = vectors_in(part)
                qids = part["id"].to_numpy()[which]
                new = [(int(i), v.tobytes()) not in seen and not seen.add((int(i), v.tobytes())) for i, v in zip(qids, q)]
                q, qids = q[new], qids[new]
                for qid, one, perm in zip(qids, q, permutations(q, shared.value, min(read, length))):
                    ids, score = index.nearest(int(qid), one, perm, k, depth)
                    out.append((np.full(len(ids), qid), np.full(len(ids), xxhash.xxh64_intdigest(one.tobytes()), np.uint64).view(np.int64), ids, score))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(dict(zip(("query_id", "of", "vec_id", "score"), cols)))

    found = blocked.groupBy("b", "q").cogroup(sent.groupBy("b", "q")).applyInArrow(of, "query_id long, of long, vec_id long, score double")
    best = Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
