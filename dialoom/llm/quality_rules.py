"""Quality rules as a ledger: every rule is evaluated once per document and its failures kept as bits.

A policy is a version's set of rules. As the ledger holds the bits and the measurements, a new policy and
the ablation of each of its rules are bitwise operations on the ledger; no text is read again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, each, table

MEASURES = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_distinct_words", "longest_word")])
MEASURES_DDL = "struct<" + ",".join(f"{f.name}:bigint" for f in MEASURES) + ">"
#: Symbols of the base measurement; fixed values of the contract.
SYMBOLS = "#*$%&|<>"


def _repeated(words: list[bytes], n: int = 3) -> tuple[int, int]:
    """Words covered by n-word windows that occur twice or more, and distinct words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(ids) <= n:
        return 0, len(number)
    key, span = ids[: len(ids) - n + 1], len(number)
    for k in range(1, n):  # renumbered at each step, so that keys never overflow
        key = np.unique(key * len(ids) + ids[k : len(ids) - n + 1 + k], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    if not twice.any():
        return 0, span
    covered = np.zeros(len(ids), bool)
    for k in range(n):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum()), span


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, as MEASURES names them; a null text has no words."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(WORD_SPACE):
                dup += line in seen
                seen.add(line)
    repeat, distinct = _repeated(words)
    upper = 0 if text.islower() else sum(w.isupper() and len(w) > 1 for w in words)
    return (len(words), len(text) - sum(map(text.count, WORD_SPACE)), sum(map(text.count, SYMBOLS)), dup, repeat, upper, distinct, max(map(len, words), default=0))


def measures(text: Column) -> Column:
    """The struct of measurements of a text column."""

    def of(texts: pa.Array) -> pa.Array:
        columns = list(zip(*map(measure_text, each(texts)))) or [[]] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(MEASURES))

    return F.arrow_udf(of, MEASURES_DDL)(text)


#: Name -> the column that is true where the rule fails. Distinct words grow about with the root of a text's length. A rule's place is its bit for good: append only.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "short": lambda m: m("n_words") < 50,
    "repeated_windows": lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"),
    "symbols": lambda m: 10 * m("n_symbols") > m("n_words"),
    "shouting": lambda m: 10 * m("n_upper_words") > 3 * m("n_words"),
    "few_distinct_words": lambda m: m("n_distinct_words") * m("n_distinct_words") < 9 * m("n_words"),
    "long_words": lambda m: m("word_chars") > 20 * m("n_words"),
    "short_words": lambda m: 2 * m("word_chars") < 4 * m("n_words"),
}
#: The rules of each policy version. "base" is the contract's own verdict.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("short", "repeated_windows"),
    "v1": ("short", "repeated_windows", "symbols", "shouting", "few_distinct_words", "long_words", "short_words"),
}


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << list(RULES).index(rule) for rule in POLICIES[policy])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, every measurement, and fail_bits: bit i is set where rule i of RULES fails.

    Null and empty texts measure zero and fail "short". Repeated rows stay repeated; an empty table gives an
    empty ledger; other columns of docs are ignored, whatever their names.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    bits = F.lit(0).cast("long")
    for i, failed in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(failed(F.col), F.lit(1 << i)).otherwise(0).cast("long"))
    return df.withColumn("fail_bits", bits)


def apply_policy(ledger_df: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds kept: none of the policy's rules failed."""
    return ledger_df.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(ledger_df: DataFrame, policy: str = "v1") -> DataFrame:
    """A row for each rule of the policy: documents that fail it, that only it rejects, and that stay without it.

    Documents are first counted by their failure bits, of which there are at most 2 ** len(RULES).
    """
    sets = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    only = F.col("bits") == F.col("r.bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return sets.withColumn("r", F.explode(rows)).groupBy(F.col("r.rule").alias("rule")).agg(
        count(hit).alias("n_failed"), count(only).alias("n_only"), count(only | (F.col("bits") == 0)).alias("n_kept_without")
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, with the base verdict and that of policy v1."""
    df = apply_policy(ledger(table(spark, sf_dir, "documents")), "v1")
    return df.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0)
