"""Ranked lexical search with block-max pruning.

Documents are indexed in blocks of BLOCK rows in a row: a block holds the terms of its documents with how often each
document has them. From the corpus statistics come each document's share for a term, the largest of which, for each
term of a block, bounds what the block's documents can score. Blocks are taken in falling order of a query's bound
and scored until the bound is below the score of the query's last place. That threshold is known from the start:
each query's best block of all is scored beforehand, so that most tasks score few blocks or none.

Queries are a stated set. They go through the documents together, in sets of about TERMS terms, and an index holds
the terms of its set alone; a set and what is known of its terms is all that the driver holds and sends out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BLOCK = 256
#: Blocks whose bounds are sorted together, which a task holds at once.
GROUP = 64
#: Pairs of a query and a term in a set of queries, about; a query is in one set whole.
TERMS = 1 << 15
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 20
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z to a-z, and ASCII characters that are no part of a term to spaces.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 97 <= i <= 122 or 48 <= i <= 57 else 32 for i in range(256))

INDEX = "block long, ids array<long>, lengths array<int>, terms array<int>, holders array<int>, places array<int>, times array<int>"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, slice by slice."""
    folded, at = raw.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def asked_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, digest, term, times: a row for each distinct term of each item. Items alike in id and text are one; texts without a term give no row."""
    low = F.translate(F.col(text_col), _UPPER, _LOWER)
    each = items.select(F.col(id_col).alias("item_id"), F.sha2(F.col(text_col), 256).alias("digest"), F.regexp_extract_all(low, F.lit(WORD), 0).alias("terms"))
    return each.dropDuplicates(["item_id", "digest"]).select("item_id", "digest", F.explode("terms").alias("term")).groupBy("item_id", "digest", "term").agg(F.count("*").alias("times"))


class Asked:
    """A set of queries: its items, its terms, and its pairs of a query and a term, by query."""

    def __init__(self, rows: list) -> None:
        key = lambda r: (r.item_id is not None, r.item_id or 0, r.digest)
        self.items = sorted({key(r) for r in rows})
        numbers = {x: i for i, x in enumerate(self.items)}
        self.terms = {t.encode(): i for i, t in enumerate(sorted({r.term for r in rows}))}
        pairs = sorted((numbers[key(r)], self.terms[r.term.encode()], r.times) for r in rows)
        self.query, self.term, self.times = (np.array([p[i] for p in pairs], np.int64) for i in range(3))
        self.starts = np.flatnonzero(np.diff(self.query, prepend=-1))
        self.of = np.split(np.arange(len(pairs)), self.starts[1:])

    def item_ids(self) -> list[tuple[int, int | None]]:
        return [(i, x[1] if x[0] else None) for i, x in enumerate(self.items)]


def index(docs: DataFrame, asked: Asked, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The forward index of docs over a set's terms, a row for each block, whose number says nothing but which it is.

    ids and lengths (terms in all) are the documents'; an entry, of which each term has holders many, has the place of its document in the block and how often it has the term.
    """
    known = docs.sparkSession.sparkContext.broadcast(asked.terms)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, ids, lengths, found, number = known.value.get, [], [], [], 0
        part = None

        def block() -> pa.RecordBatch:
            nonlocal number
            sizes = [len(f) for f in found]
            entries = np.fromiter((t for f in found for t in f), np.int64, sum(sizes)) * BLOCK + np.repeat(np.arange(len(found)), sizes)
            entries, times = np.unique(entries, return_counts=True)
            terms, holders = np.unique(entries // BLOCK, return_counts=True)
            columns = [[part << 33 | number], [list(ids)], [list(lengths)], [terms], [holders], [entries % BLOCK], [times]]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 5]
            number += 1
            ids.clear(), lengths.clear(), found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "ids", "lengths", "terms", "holders", "places", "times"])

        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) else part
            for doc, raw in zip(batch.column("doc_id"), batch.column("text")):
                n, own = 0, []
                for some in terms_of(raw.as_py() or b""):
                    n += len(some)
                    own += [t for t in map(get, some) if t is not None]
                ids.append(doc.as_py())
                lengths.append(n)
                found.append(own)
                if len(ids) == BLOCK:
                    yield block()
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(blocks, INDEX)


class _Scorer:
    """What scores the blocks of an index for a set of queries, given the corpus statistics and each query's threshold."""

    def __init__(self, asked: Asked, n_docs: int, n_terms: int, holders: dict[int, int], best: int) -> None:
        self.asked, self.n_docs, self.n_terms, self.best = asked, n_docs, max(n_terms, 1), best
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders.get(t, 0) + 1))) for t in range(len(asked.terms))], np.int64)
        self.weights = weight[asked.term] * asked.times
        self.least = np.ones(len(asked.items), np.int64)  # scores below it have no place

    def shares(self, row: dict) -> np.ndarray:
        """What each entry of a block adds to a score for a unit of its term's weight."""
        m = 75 + 25 * row["lengths"].astype(np.int64) * self.n_docs // self.n_terms
        tf = row["times"].astype(np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 12 * m[row["places"]])

    def bounds(self, row: dict) -> np.ndarray:
        """The most that a document of the block can score, for each query: from the largest share of each term."""
        most = np.zeros(len(self.asked.terms), np.int64)
        if len(row["terms"]):
            most[row["terms"]] = np.maximum.reduceat(self.shares(row), np.cumsum(row["holders"]) - row["holders"])
        return np.add.reduceat(most[self.asked.term] * self.weights, self.asked.starts)

    def scores(self, row: dict, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each query's scores of the block's documents."""
        column = np.full(len(self.asked.terms), -1)
        column[row["terms"]] = np.arange(len(row["terms"]))
        matrix = np.zeros((len(row["lengths"]), len(row["terms"])), np.int64)
        matrix[row["places"], np.repeat(np.arange(len(row["terms"])), row["holders"])] = self.shares(row)
        for q in queries.tolist():
            pairs = self.asked.of[q]
            at = column[self.asked.term[pairs]]
            yield q, matrix[:, at[at >= 0]] @ self.weights[pairs][at >= 0]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Blocks as numpy arrays; a null id has its place in missing."""
    names = batch.schema.names
    for i in range(len(batch)):
        row = {n: batch.column(n)[i] for n in names}
        ids = row["ids"].values
        yield {
            "block": row["block"].as_py(), "ids": ids.fill_null(0).to_numpy(zero_copy_only=False), "missing": ids.is_null().to_numpy(zero_copy_only=False),
            **{n: row[n].values.to_numpy(zero_copy_only=False) for n in ("lengths", "terms", "holders", "places", "times")},
            "queries": np.array(row["queries"].as_py()) if "queries" in names else None,
        }


class _Places:
    """The best documents of each query so far."""

    def __init__(self, scorer: _Scorer) -> None:
        self.scorer, self.least = scorer, scorer.least.copy()
        self.held: dict[int, list[np.ndarray]] = {}

    def take(self, q: int, scores: np.ndarray, row: dict) -> None:
        if len(at := np.flatnonzero(scores >= self.least[q])):
            some = np.stack([scores[at], row["missing"][at].astype(np.int64), row["ids"][at]])
            held = self.held.setdefault(q, [])
            held.append(some)
            if sum(x.shape[1] for x in held) >= 2 * self.scorer.best:
                self.held[q] = [some := self.sorted(q)]
                if some.shape[1] == self.scorer.best:
                    self.least[q] = max(self.least[q], some[0, -1])

    def sorted(self, q: int) -> np.ndarray:
        some = np.concatenate(self.held[q], axis=1)
        return some[:, np.lexsort((some[2], some[1], -some[0]))[: self.scorer.best]]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for q in self.held:
            score, missing, ids = self.sorted(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int32()), pa.array(ids, pa.int64(), mask=missing.astype(bool)), pa.array(score, pa.int64())], ["query", "doc_id", "score"])


def score_group(rows: list[dict], one: _Scorer, places: _Places) -> int:
    """Scores blocks for each query in the order of their bounds, as long as a bound reaches the query's threshold. How many times a block was scored for a query."""
    bounds = np.stack([one.bounds(row) for row in rows])
    order = np.argsort(-bounds, axis=0, kind="stable")  # each query's blocks by falling bound
    scored = 0
    for nth in range(len(rows)):
        going = np.flatnonzero(bounds[order[nth], np.arange(len(one.asked.items))] >= places.least)
        if not len(going):  # all bounds have dropped below their thresholds, and only fall from here
            break
        scored += len(going)
        for b in np.unique(order[nth][going]).tolist():
            for q, scores in one.scores(rows[b], going[order[nth][going] == b]):
                places.take(q, scores, rows[b])
    return scored


def _best_blocks(blocks: DataFrame, scorer: _Scorer) -> DataFrame:
    """query, bound, block: for each task and query the block of the largest bound."""
    known = blocks.sparkSession.sparkContext.broadcast(scorer)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = known.value
        most, where = np.zeros(len(one.asked.items), np.int64), np.zeros(len(one.asked.items), np.int64)
        for batch in batches:
            for row in _rows(batch):
                now = one.bounds(row)
                where[now > most] = row["block"]
                most = np.maximum(most, now)
        q = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(most[q], pa.int64()), pa.array(where[q], pa.int64())], ["query", "bound", "block"])

    return blocks.mapInArrow(of, "query int, bound long, block long")


def _scored(blocks: DataFrame, scorer: _Scorer) -> DataFrame:
    """query, doc_id, score of each task's best documents. Blocks with a column queries are scored for those alone, the others as far as their bounds ask for."""
    known = blocks.sparkSession.sparkContext.broadcast(scorer)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = known.value
        places, held = _Places(one), []
        for batch in batches:
            for row in _rows(batch):
                if row["queries"] is not None:
                    for q, scores in one.scores(row, row["queries"]):
                        places.take(q, scores, row)
                    continue
                held.append(row)
                if len(held) == GROUP:
                    score_group(held, one, places)
                    held = []
        if held:
            score_group(held, one, places)
        yield from places.batches()

    return blocks.mapInArrow(of, "query int, doc_id long, score long")


def _ranked(scored: DataFrame, best: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return scored.withColumn("rank", nth).where(F.col("rank") <= best)


def _search_set(docs: DataFrame, asked: Asked, best: int) -> DataFrame:
    spark = docs.sparkSession
    blocks = cut(index(docs, asked), "lexical-index")
    n_docs, n_terms = blocks.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    entry = F.explode(F.arrays_zip("terms", "holders"))
    holders = dict(map(tuple, blocks.select(entry.alias("e")).groupBy("e.terms").agg(F.sum("e.holders")).collect()))  # at most one for each of the set's terms
    scorer = _Scorer(asked, n_docs, n_terms, holders, best)
    first = _best_blocks(blocks, scorer).groupBy("query").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    wanted = first.groupBy("block").agg(F.collect_list("query").alias("queries"))  # no more than the set has
    last_place = _ranked(_scored(blocks.join(wanted, "block"), scorer), best).where(F.col("rank") == best)
    for q, score in last_place.select("query", "score").collect():  # at most one for each of the set's queries
        scorer.least[q] = score
    items = spark.createDataFrame(asked.item_ids(), "query int, item_id long")
    found = _ranked(_scored(blocks, scorer), best)
    return found.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best documents with a score above 0; equal scores go by doc_id, nulls last.

    docs has doc_id and text, items item_id and text; other columns are ignored, whatever their names. Each row of docs
    is a document of its own, repeated ones too; items alike in id and text are one item, items of one id with other
    texts are items of their own. Null and empty texts have no terms: such documents are in no statistics and no
    result, such items have no result. The rank of equal documents without an id, or with one id, is either's.
    """
    pairs = cut(asked_terms(items), "lexical-items")
    n_sets = max(1, -(-pairs.count() // TERMS))
    of_set: Column = F.pmod(F.xxhash64("item_id", "digest"), F.lit(n_sets))
    sets = (Asked(rows) for i in range(n_sets) if (rows := pairs.where(of_set == i).collect()))
    found = [_search_set(docs, asked, best) for asked in sets]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that each benchmark item finds."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
