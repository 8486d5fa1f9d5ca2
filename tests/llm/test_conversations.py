"""Conversation repair against every edit there is, in segments of any length, on odd rows."""

import hashlib
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialoom.llm import conversations as cv

INF = (1 << 40, "")


def plain_best(turns):
    """The least (cost, audit) by trying every edit, at most two inserts in a row."""

    @lru_cache(None)
    def best(i, out, row_of_inserts):
        """What is least after turn i, out being the initials so far as far as they matter: '', s, u or a."""
        found = [(0, "")] if i == len(turns) and out in ("", "a") else []
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[out]
        go = lambda cost, edit, rest: found.append((cost + rest[0], edit + rest[1]))
        for r in nexts:
            if r != "s" and row_of_inserts < 2:
                go(5, "I", best(i, r, row_of_inserts + 1))
        if i < len(turns):
            role, _, fault = turns[i]
            go(2, "D", best(i + 1, out, 0))
            if fault not in (cv.BLANK, cv.DUPLICATE):
                more = 5 * (fault == cv.CUT_OFF)
                for r in nexts:
                    if role[:1] == r:
                        go(more, "K", best(i + 1, r, 0))
                    if r != "s":
                        go(1 + more, "R", best(i + 1, r, 0))
        return min(found, default=INF)

    return best(0, "", 0)


TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x", ""]), st.sampled_from(["a.", "b", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=9)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_search(turns):
    assert min(cv.search(turns).values()) == plain_best(turns)


def plain_text(turns, audit):
    rows, out = iter(turns), []
    for edit in audit:
        turn = next(rows) if edit != "I" else None
        if edit != "D":
            want = "assistant" if out and out[-1][:1] == "u" else "user"
            out.append(f"{turn[0]}:{turn[1]}" if edit == "K" else f"{want}:{turn[1] if turn else ''}")
    return "\n".join(out)


@settings(max_examples=300, deadline=None)
@given(TURNS, st.integers(1, 4))
def test_segments(turns, size):
    """Cut into segments a conversation has the same repair."""
    was, cv.SEGMENT = cv.SEGMENT, size
    try:
        one = cv.Repair()
        for i, t in enumerate(turns):
            one.add(i, *t)
        got = one.result()
    finally:
        cv.SEGMENT = was
    cost, audit = plain_best(turns)
    assert (got["cost"], got["audit"]) == (cost, audit)
    assert got["repaired_sha256"] == hashlib.sha256(plain_text(turns, audit).encode()).hexdigest()


def test_long_conversation_of_many_segments():
    """A hundred thousand turns, nearly all to be re-roled, so that ways differ from the first turn on: time in proportion, and few turns held."""
    for kind in ("x", "user"):
        one = cv.Repair()
        for i in range(100_001):
            one.add(i, kind, f"t{i}.", cv.SOUND)
            assert len(one.turns) <= cv.SEGMENT
        got = one.result()
        assert len(got["audit"]) == 100_001 and got["audit"].count("D") == 1 and got["cost"] == 2 + (100_000 if kind == "x" else 50_000)


def plain_rows(rows):
    """The contract over rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
            turns += [(turn is not None, turn or 0, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
        turns.sort()
        seen, judged = set(), []
        for _, _, role, text in turns:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            judged.append((role, text, cv.BLANK if not words else cv.DUPLICATE if (role, text) in seen else cv.CUT_OFF if words[-1] not in ".!?" else cv.SOUND))
            seen.add((role, text))
        numbers = [t[1] for t in turns if t[0]]
        cost, audit = plain_best(judged)
        count = lambda k: sum(f == k for _, _, f in judged)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, count(cv.BLANK), count(cv.DUPLICATE), count(cv.CUT_OFF), illegal, cost, audit, hashlib.sha256(plain_text(judged, audit).encode()).hexdigest())
    return out


DDL = "conv_id long, turn long, role string, text string"


def same(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], f"{DDL}, fault string, gone string, i int")
    got = cv.repair(cv.damage(df)).collect()
    want = plain_rows(rows)
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:9] for r in got} == want


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:9] for r in cv.op11_conversation_repair(spark, sf).collect()} == plain_rows(rows)


def test_odd_rows(spark):
    said = ["Hello.", "What?", "", " \t", None, "no end", "Wait!  ", "x ", "日本。", "Hello."]
    roles = ["user", "assistant", "system", None, "", "usher", "assistant", "user"]
    rows = [(c if c % 13 else None, t if (c + t) % 7 else None, roles[(t * 5 + c) % 8], said[(c * 3 + t * 7) % 10]) for c in range(60) for t in range(c % 9)]
    rows += rows[:40]  # repeated rows
    rows += [(99, t, "user", "y.") for t in (1, 1, 1)] + [(100, None, None, None)] * 3 + [(101, 1 << 40, "user", "z" * 200_000 + "."), (101, 0, "system", "s.")]
    same(spark, rows)
    assert cv.repair(cv.damage(spark.createDataFrame([], DDL))).count() == 0
    dropped = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    r = cv.repair(cv.damage(spark.createDataFrame([(dropped, 0, "user", "a.")], DDL))).first()
    assert tuple(r) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), 0)


def test_one_conversation_of_a_third_of_the_rows(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"t{t % 50}.") for t in range(3000)] + [(8 + i // 4, i % 4, "user" if i % 2 == 0 else "assistant", "a.") for i in range(6000)]
    got = {r.conv_id: r for r in cv.repair(cv.damage(spark.createDataFrame(rows, DDL))).collect()}
    assert len(got) == 1501 and got[7].duplicate > 2500 and len(got[7].audit) >= 2700


def test_one_shuffle(spark, sf):
    plan = cv.op11_conversation_repair(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


@pytest.mark.parametrize("conv", [None, 5])
def test_batches_carry_conversations_on(spark, conv):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        same(spark, [(conv, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(20)])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
