"""Repair of conversation structure by cheapest paths through a lattice of edits.

A node is (turns taken, state of the role grammar); an edge keeps, re-roles or deletes the next turn, or inserts
one. Dijkstra's search pops nodes by (cost, audit), audit being the initials of the edits so far, and stops at the
first accepting end node, which is then the cheapest repair with the least audit.

Conversations are dealt by their ids and sorted by Spark, so that a task reads each one as a stream of turns and
holds no more than SEGMENT of them. A longer one is searched segment by segment, from each state to each state;
of what leads to a state at a segment's end only the best is kept, with its digest so far.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Turns, and characters of their texts, that a task holds at once.
SEGMENT, SEGMENT_CHARS = 512, 1 << 22
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. Where each role's initial leads from each.
START, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
NEXT = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
ACCEPTING = (START, AFTER_A)
#: Costs of edits; fixed values.
RE_ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

Turn = tuple[str, str, int]
Path = tuple[int, str]


def _steps(turns: list[Turn], i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """Cost, initial and end (turns taken, state) of each edit at a node."""
    for role, to in NEXT[state].items():
        if role != "s":
            yield INSERT, "I", i, to
            if i < len(turns) and turns[i][2] not in (BLANK, DUPLICATE):
                yield RE_ROLE + TRUNCATED * (turns[i][2] == CUT_OFF), "R", i + 1, to
    if i < len(turns):
        yield DELETE, "D", i + 1, state
        role, _, fault = turns[i]
        if fault not in (BLANK, DUPLICATE) and (to := NEXT[state].get(role[:1])) is not None:
            yield TRUNCATED * (fault == CUT_OFF), "K", i + 1, to


def search(turns: list[Turn], start: int = START, ends: tuple[int, ...] = ACCEPTING, first: bool = True) -> dict[int, Path]:
    """The best (cost, audit) from a state before the turns to each of the end states after them, or to the first popped alone."""
    heap, done, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in ends:
            found[state] = (cost, audit)
            if first or len(found) == len(ends):
                break
        for more, edit, j, to in _steps(turns, i, state):
            if (j, to) not in done:
                heapq.heappush(heap, (cost + more, audit + edit, j, to))
    return found


def repaired(turns: list[Turn], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """Role and text of the turns that an audit's edits leave."""
    rows = iter(turns)
    for edit in audit:
        role, text, _ = next(rows) if edit != "I" else ("", "", SOUND)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if state == AFTER_U else "u"]
        yield role, text
        state = NEXT[state][role[:1]]


class _Way:
    """The best repair so far that ends in a state: cost, place among the ways' audits, inserts at its end, audit in pieces, digest."""

    def __init__(self, cost: int, rank: int, inserts: int, pieces: tuple | None, digest, lines: int) -> None:  # noqa: ANN001
        self.cost, self.rank, self.inserts, self.pieces, self.digest, self.lines = cost, rank, inserts, pieces, digest, lines

    def on(self, audit: str, turns: list[Turn], state: int) -> tuple[tuple, object, int]:
        digest, lines = self.digest.copy(), self.lines
        for role, text in repaired(turns, audit, state):
            digest.update((f"\n{role}:{text}" if lines else f"{role}:{text}").encode("utf-8", "surrogatepass"))
            lines += 1
        return (self.pieces, audit), digest, lines

    def audit(self) -> str:
        out, at = [], self.pieces
        while at:
            at, piece = at
            out.append(piece)
        return "".join(reversed(out))


class Repair:
    """One conversation's repair and counts, from its turns in order, of which it holds a segment."""

    def __init__(self) -> None:
        self.turns: list[Turn] = []
        self.chars = 0
        self.ways = {START: _Way(0, 0, 0, None, hashlib.sha256(), 0)}
        self.faults = [0] * 4
        self.illegal = self.distinct = 0
        self.before: str | None = None
        self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        if len(self.turns) == SEGMENT or self.chars > SEGMENT_CHARS:
            self._take(tuple(STATES))
        self.turns.append((role, text, fault))
        self.chars += len(text)

    def _take(self, ends: tuple[int, ...]) -> None:
        """Goes on from each way over the turns at hand.

        Audits are compared without being joined. Two ways' audits without the inserts at their ends are equal or differ
        within, as both have an edit for each turn: their order is a rank, and beyond it what comes after decides.
        """
        alone = len(self.ways) == 1 and ends == ACCEPTING  # the whole conversation: the first end popped will do
        paths = {p: search(self.turns, p, ends, alone) for p in self.ways}
        best: dict[int, tuple[tuple, int, str]] = {}
        for p, way in self.ways.items():
            for q, (cost, audit) in paths[p].items():
                key = (way.cost + cost, way.rank, "I" * way.inserts + audit)
                if q not in best or key < best[q][0]:
                    best[q] = (key, p, audit)
        order = sorted({(key[1], key[2].rstrip("I")) for key, _, _ in best.values()})
        ways = {}
        for q, (key, p, audit) in best.items():
            bare = key[2].rstrip("I")
            ways[q] = _Way(key[0], order.index((key[1], bare)), len(key[2]) - len(bare), *self.ways[p].on(audit, self.turns, p))
        self.ways, self.turns, self.chars = ways, [], 0

    def result(self) -> dict:
        self._take(ACCEPTING)
        way = min(self.ways.values(), key=lambda w: (w.cost, w.rank, w.inserts))
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        return {
            "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT_OFF], "illegal": self.illegal,
            "cost": way.cost, "audit": way.audit(), "repaired_sha256": way.digest.hexdigest(), "n_repaired": way.lines,
        }


def faults(turns: DataFrame, *key: str) -> DataFrame:
    """Adds fault to turns (key columns, turn, role, text): the first of blank, duplicate and truncated that holds.

    A duplicate has role and text of an earlier turn of its conversation. Earlier is by turn, nulls first, then role
    and text; rows alike in all come one after the other.
    """
    nth = F.row_number().over(Window.partitionBy(*key, "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    said = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(said == "", BLANK).when(nth > 1, DUPLICATE).when(~F.right(said, F.lit(1)).isin(*".!?"), CUT_OFF)
    return turns.withColumn("fault", F.coalesce(fault, F.lit(SOUND)))


REPAIR = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_repaired long"
_KINDS = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("n_repaired", pa.int64())]


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of rows in order; one that goes on in the next batch is carried on."""
    key, one = None, None
    kind = pa.schema([("conv_id", pa.int64()), *_KINDS])
    for batch in batches:
        out = []
        for conv, gone, turn, role, text, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "gone", "turn", "role", "text", "fault"))):
            if one is None or conv != key:
                if one is not None:
                    out.append({"conv_id": key} | one.result())
                key, one = conv, Repair()
            if not gone:
                one.add(turn, role, text, fault)
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)
    if one is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": key} | one.result()], kind)


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_repaired of each conversation.

    turns has conv_id, turn, role, text and gone; rows that are gone count for nothing but that their conversation is
    there. Other columns are ignored, whatever their names. A null role or text is one space; rows with a null conv_id
    are one conversation. Turns go by number, nulls first, then role and text, so that repeated rows and ties have one
    order. A conversation without turns has zeros, an empty audit and the hash of nothing.

    One shuffle, by conversation. A conversation is a single row of the result, and its hash has to be taken in order:
    one task reads it, as a sorted stream, in memory that doesn't grow with its length but for a byte of audit a turn.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), F.coalesce("gone", F.lit(False)).alias("gone"))
    judged = faults(rows.repartition("conv_id"), "conv_id", "gone")
    return judged.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(_repairs, f"conv_id long, {REPAIR}")


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with turns dropped (gone), emptied, stripped of full stops, repeated and given to the user, as the remainder of crc32(conv_id:turn) by 20 says.

    Nulls are one space, in what the checksum is of as well; turn stays null for the order.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case: Callable[[int], Column] = lambda n: F.col("case") == n
    cased = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("case"))
    said = F.when(case(1), "").when(case(2), F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    done = cased.select("conv_id", "turn", F.when(case(4), "user").otherwise(F.col("role")).alias("role"), said.alias("text"), case(0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(case(3), 2).otherwise(1))).alias("copy"))
    return done.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, with its faults and the cheapest repair."""
    return repair(damage(table(spark, sf_dir, "conversations")))
