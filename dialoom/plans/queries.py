"""Queries over the driver's tables, each with SQL for the same rows.

The tables hold no consultations, so a query applies an operator to columns that are like its own: the user of a
conversation is the patient, the assistant the doctor, the system the caregiver; a conversation is a visit, a
part's size an age, an order's quantities the items of a scale, a document's lines a transcript.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clinical
from ..functions.text import after, lines, to_int
from ..operators import audit, dataset, dialogue, masking, scales, speakers, stats
from . import consultations  # noqa: F401  registers its queries
from .registry import EMAIL, ORACLE_SQL, QUERIES, query, read, spread  # noqa: F401

_ROLE = "CASE role WHEN 'user' THEN 'patient' WHEN 'assistant' THEN 'doctor' WHEN 'system' THEN 'caregiver' ELSE 'other' END"
_STATS = "count({0})::BIGINT AS count, round(avg({0}), 2) AS mean, round(median({0}), 2) AS median, min({0}) AS min, max({0}) AS max"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt to all cores where the table is small."""
    return spread(read(spark, sf_dir, "documents"), "doc_id", "text")


def _label(role: Column) -> Column:
    """A speaker label for a role of the conversations table."""
    return F.when(role == "user", "P1").when(role == "assistant", "医生").when(role == "system", "患者家属").otherwise("x")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").withColumn("role", clinical.role_of(_label(F.col("role"))))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as patients of one visit each, assembled as the build does."""
    turn = F.struct("turn", F.struct("role", "text", F.lit(None).cast("string").alias("speaker_note")).alias("t"))
    by = _turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("x"))
    none = lambda kind: F.lit(None).cast(kind)
    meta = F.struct(F.array(F.col("conv_id").cast("int")).alias("ids"), F.concat(F.lit("n"), "conv_id").alias("name"), none("string").alias("gender"), none("int").alias("age"))
    visits = F.array(F.struct(F.lit(1).alias("visit_no"), F.transform("x", lambda x: x["t"]).alias("turns")))
    parsed = by.select(F.col("conv_id").alias("file_id"), F.lit("conversations").alias("path"), none("string").alias("error"), meta.alias("meta"), none("array<string>").alias("keywords"), none(scales.RECORDS).alias("scales"), visits.alias("visits"))
    return dataset.assemble(parsed)


@query(f"SELECT {_ROLE} AS key, count(*)::BIGINT AS n FROM conversations GROUP BY 1")
def turn_role_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(_turns(spark, sf_dir), F.col("role"), "other")


@query(f"SELECT {_STATS.format('n')} FROM (SELECT conv_id, count(*)::BIGINT AS n FROM conversations GROUP BY 1)")
def turns_per_visit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.safe_stats(_turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n")), "n")


@query(f"SELECT {_STATS.format('n')} FROM (SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)")
def visits_per_patient_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order count with zero; orders are counted before they meet the customers."""
    n = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = read(spark, sf_dir, "customer").select("c_custkey")
    return stats.safe_stats(c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left"), F.coalesce("n", F.lit(0)))


@query("SELECT CASE WHEN p_size IS NULL THEN 'unknown' WHEN p_size <= 12 THEN '0-12' WHEN p_size <= 17 THEN '13-17' WHEN p_size <= 44 THEN '18-44' WHEN p_size <= 59 THEN '45-59' ELSE '60+' END AS key, count(*)::BIGINT AS n FROM part GROUP BY 1")
def age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(read(spark, sf_dir, "part"), clinical.age_band(F.col("p_size")))


_TOTAL = "(SELECT l_orderkey, (sum(l_quantity::BIGINT) % {0})::INT AS total FROM lineitem GROUP BY 1)"


def _order_totals(spark: SparkSession, sf_dir: str, modulus: int) -> DataFrame:
    total = (F.sum(F.col("l_quantity").cast("long")) % modulus).cast("int")
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(total.alias("total"))


@query(f"SELECT CASE WHEN total <= 4 THEN 'minimal' WHEN total <= 9 THEN 'mild' WHEN total <= 14 THEN 'moderate' ELSE 'severe' END AS key, count(*)::BIGINT AS n FROM {_TOTAL.format(22)} GROUP BY 1")
def gad7_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(_order_totals(spark, sf_dir, 22), clinical.gad7_severity(F.col("total")))


@query(f"SELECT CASE WHEN total <= 4 THEN 'minimal' WHEN total <= 9 THEN 'mild' WHEN total <= 14 THEN 'moderate' WHEN total <= 19 THEN 'moderately_severe' ELSE 'severe' END AS key, count(*)::BIGINT AS n FROM {_TOTAL.format(28)} GROUP BY 1")
def phq9_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(_order_totals(spark, sf_dir, 28), clinical.phq9_severity(F.col("total")))


@query("SELECT l_orderkey AS order_key, string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY l_linenumber, l_quantity) AS items, sum(l_quantity::INT)::INT AS total FROM lineitem GROUP BY 1")
def scale_item_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    by = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.sort_array(F.collect_list(item)).alias("x"))
    items = F.transform("x", lambda x: x["q"])
    return by.select("order_key", F.array_join(items, ",").alias("items"), scales.item_sum(items).alias("total"))


_WITH = "max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 1"
_SPLIT = f"(SELECT conv_id, CASE WHEN {_WITH} THEN 'with_caregiver' ELSE 'without_caregiver' END AS split FROM conversations GROUP BY 1)"


@query(f"SELECT printf('P-%06d', conv_id) AS patient_id, split FROM {_SPLIT}")
def caregiver_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split(_nested(spark, sf_dir)).select("patient_id", "split")


@query(f"SELECT split, count(*)::BIGINT AS total_patients, count(*)::BIGINT AS total_visits, 7::BIGINT AS source_total_files, 6::BIGINT AS source_converted_files FROM {_SPLIT} GROUP BY 1")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.split_counts(dataset.split(_nested(spark, sf_dir)), 7, 6)


@query("SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system')")
def caregiver_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat form of the split: a semi-join."""
    return dataset.turns_with(_turns(spark, sf_dir), "conv_id").select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system')")
def turns_without_caregiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.turns_without(_turns(spark, sf_dir), "conv_id").select("conv_id", "turn")


@query(f"SELECT conv_id, turn, {_ROLE} AS role FROM conversations")
def role_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", "role")


_LINES = "(SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(lower(text), chr(10)), 1) AS no FROM documents)"


@query(f"""WITH s AS (SELECT doc_id, line, no, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS seg FROM {_LINES}),
v AS (SELECT doc_id, seg, trim(string_agg(line, chr(10) ORDER BY no), ' ' || chr(10)) AS t FROM s WHERE length(line) >= 40 GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg)::INT AS visit_no, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM v""")
def visit_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under 40 characters separate a document's visits."""
    text = F.array_join(F.transform(lines(F.lower("text")), lambda x: F.when(F.length(x) < 40, "OUT").otherwise(x)), "\n")
    v = _documents(spark, sf_dir).select("doc_id", F.posexplode(dialogue.visits(text)).alias("i", "v"))
    return v.select("doc_id", (F.col("i") + 1).alias("visit_no"), F.length("v").cast("long").alias("n_chars"), F.md5("v").alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
s AS (SELECT doc_id, line, no, sum(CASE WHEN regexp_matches(line, '^[A-M]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS t FROM l),
j AS (SELECT doc_id, t, string_agg(trim(line), '' ORDER BY no) AS x FROM s WHERE t > 0 GROUP BY ALL)
SELECT doc_id, t::INT AS turn_no, 'doctor' AS role, md5(x) AS digest FROM j""")
def turn_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with A to M open a document's turns."""
    text = F.array_join(F.transform(lines(F.col("text")), lambda x: F.when(x.rlike("^[A-M]"), F.concat(F.lit("[D1]"), x)).otherwise(x)), "\n")
    t = _documents(spark, sf_dir).select("doc_id", F.posexplode(dialogue.turns(text)).alias("i", "t"))
    return t.select("doc_id", (F.col("i") + 1).alias("turn_no"), "t.role", F.md5("t.text").alias("digest"))


@query("SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carry_forward_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last signup or error holds until the next."""
    kind = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    return speakers.carry_forward(read(spark, sf_dir, "events"), kind, ["user_id"], ["ts", "event_id"], "carried").select("event_id", "carried")


@query("SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) % 2 = 1 THEN 'doctor' ELSE 'patient' END AS speaker FROM conversations WHERE length(text) > 20")
def alternating_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = read(spark, sf_dir, "conversations").where(F.length("text") > 20)
    return speakers.alternate(kept, F.lit("doctor"), F.lit("patient"), ["conv_id"], ["turn"], "speaker").select("conv_id", "turn", "speaker")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT doc_id, count(*) AS turns FROM l WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '[:：]$') GROUP BY 1)
SELECT doc_id, coalesce(turns, 0)::BIGINT AS heuristic_turns, (length(text) + 5 * coalesce(turns, 0))::BIGINT AS n_chars_out FROM documents LEFT JOIN n USING (doc_id)""")
def speaker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as unlabelled transcripts: every line but blank ones and headers gets a speaker's label of five characters."""
    files = _documents(spark, sf_dir).select(F.col("doc_id").alias("file_id"), F.col("source").alias("stem"), "text")
    done = speakers.label(files)
    return done.select(F.col("file_id").alias("doc_id"), "heuristic_turns", F.length("text_out").cast("long").alias("n_chars_out"))


@query("SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN strpos(text, ' the ') > 0 THEN substr(text, strpos(text, ' the ')) ELSE text END AS t FROM documents)")
def trim_to_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _documents(spark, sf_dir).select("doc_id", after(F.col("text"), " the ").alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(translate(text, ',.', '，、'), '[、，]'), lambda x: trim(x, ' ' || chr(9) || chr(10)) <> '') AS w FROM documents)
SELECT doc_id, (generate_subscripts(w, 1) - 1)::INT AS pos, trim(unnest(w), ' ，、') AS token FROM t""")
def keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at their commas and full stops, which stand for the keyword separators."""
    words = dialogue.keyword_list(F.translate("text", ",.", "，、"))
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(words).alias("pos", "token"))


@query("SELECT c_custkey, regexp_extract(split_part(c_name, '#', 2), '^([0-9]+)', 1)::INT AS id, 1::INT AS n_ids FROM customer")
def title_prefix_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = clinical.prefix_ids(F.split_part("c_name", F.lit("#"), F.lit(2)))
    return read(spark, sf_dir, "customer").select("c_custkey", F.get(ids, F.lit(0)).alias("id"), F.size(ids).alias("n_ids"))


_NAMED = "(SELECT 'labels' AS folder, 'l' || doc_id AS name, doc_id::INT AS id FROM labels UNION ALL SELECT 'orders', 'o' || o_orderkey, o_custkey::INT FROM orders)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and orders as two folders of files named by their keys."""
    one = lambda t, folder, letter, key, stem: read(spark, sf_dir, t).select(F.lit(folder).alias("folder"), F.concat(F.lit(letter), F.col(key).cast("string")).alias("name"), F.col(stem).cast("string").alias("stem"))
    return audit.named_ids(one("labels", "labels", "l", "doc_id", "doc_id").unionByName(one("orders", "orders", "o", "o_orderkey", "o_custkey")))


@query(f"SELECT folder, id, count(*)::BIGINT AS n FROM {_NAMED} GROUP BY ALL HAVING count(*) > 1")
def id_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicates(_named(spark, sf_dir))


@query(f"SELECT folder, count(*)::BIGINT AS file_count, count(*)::BIGINT AS parsed_file_count, count(*)::BIGINT AS total_prefix_count, count(DISTINCT id)::BIGINT AS unique_prefix_count FROM {_NAMED} GROUP BY 1")
def id_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.folder_counts(_named(spark, sf_dir))


@query(f"SELECT folder, id, string_agg(name, ',' ORDER BY name) AS names FROM {_NAMED} GROUP BY ALL")
def id_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.index(_named(spark, sf_dir)).withColumn("names", F.array_join("names", ","))


@query("SELECT id FROM (SELECT unnest(range(1, max(doc_id) + 1)) AS id FROM documents) WHERE id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from 1 to the largest of the documents that no label has."""
    last = read(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0
    return audit.missing_ids(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), 1, last)


@query("""WITH k AS (SELECT DISTINCT 999999999999 - o_custkey * 1000003 AS id FROM orders UNION SELECT unnest([0, 1000000000000])),
g AS (SELECT id, lag(id) OVER (ORDER BY id) AS before FROM k)
SELECT before + 1 AS first, id - 1 AS last FROM g WHERE id - before > 1""")
def missing_id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps among ids near 10^12 with wide spaces between, as first and last number of each."""
    ids = read(spark, sf_dir, "orders").select((F.lit(999999999999) - F.col("o_custkey") * 1000003).alias("id"))
    return audit.missing_ranges(ids, 1, 999999999999)


@query("SELECT doc_id AS id FROM documents UNION SELECT doc_id FROM labels")
def union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [read(spark, sf_dir, t).select(F.lit(t).alias("folder"), F.col("doc_id").cast("string").alias("name"), F.col("doc_id").cast("string").alias("stem")) for t in ("documents", "labels")]
    return audit.all_ids(audit.named_ids(names[0].union(names[1]))).select(F.col("id").cast("long").alias("id"))


@query("SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels")
def unlabelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read(spark, sf_dir, t).select(F.col("doc_id").alias("id")) for t in ("documents", "labels"))
    return audit.difference(docs, labels)


@query("SELECT s_suppkey, replace(s_name, '#', '-') AS patient_id, split_part(s_name, '#', 2)::BIGINT AS sort_key FROM supplier")
def numeric_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of patients, as the key that they're sorted by."""
    pid = F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", pid.alias("patient_id"), clinical.numeric_suffix(pid).alias("sort_key")).orderBy("sort_key", "patient_id")


@query("SELECT s_suppkey, printf('P-%06d', s_suppkey) AS patient_id, printf('V-%06d-%d', s_suppkey, s_nationkey) AS visit_id FROM supplier")
def format_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select("s_suppkey", clinical.patient_id(F.col("s_suppkey")).alias("patient_id"), clinical.visit_id(F.col("s_suppkey"), F.col("s_nationkey")).alias("visit_id"))


@query(f"SELECT doc_id, md5(t) AS digest, t <> text AS changed FROM (SELECT doc_id, text, regexp_replace(text, '{EMAIL}', '[NAME]', 'g') AS t FROM documents)")
def mask_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses stand for names: only texts with an at-sign are searched."""
    pattern = re.compile(EMAIL)
    found = masking.detect(F.col("text"), lambda t: [(*m.span(), "PER") for m in pattern.finditer(t)] if "@" in t else [], size=1 << 30)
    masked = _documents(spark, sf_dir).select("doc_id", "text", found.alias("spans")).select("doc_id", "text", masking.replace_spans(F.col("text"), F.col("spans")).alias("t"))
    return masked.select("doc_id", F.md5("t").alias("digest"), (F.col("t") != F.col("text")).alias("changed"))


@query("SELECT doc_id, s::INT AS start, md5(substr(text, (s + 1)::BIGINT, 400)) AS digest FROM documents, range(0, greatest(length(text), 0), 400) t(s)")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _documents(spark, sf_dir).select("doc_id", F.explode(masking.chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", "c.start", F.md5("c.chunk").alias("digest"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def score_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")


_NUMBER = "CASE WHEN user_id % 7 = 0 THEN 'n/a' ELSE user_id::VARCHAR END"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of a build: those without a number have failed, a value above 50 is a gender that is known."""
    raw = F.when(F.col("user_id") % 7 == 0, "n/a").otherwise(F.col("user_id").cast("string"))
    none = F.array().cast("array<string>")
    df = read(spark, sf_dir, "events").select("event_type", F.col("event_id").cast("string").alias("path"), F.when(F.col("value") > 50, "x").alias("gender"), to_int(raw).alias("age"))
    return df.withColumns({"error": F.when(F.col("age").isNull(), "bad_item"), "keywords": none, "scales": none, "visits": none})


@query(f"SELECT event_type, count(*)::BIGINT AS total, count(TRY_CAST({_NUMBER} AS INT))::BIGINT AS converted, (count(*) - count(TRY_CAST({_NUMBER} AS INT)))::BIGINT AS failed, count(CASE WHEN value > 50 THEN 1 END)::BIGINT AS with_value FROM events GROUP BY 1")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = dataset.build_figures(_numbered(spark, sf_dir), "event_type")
    return counts.select("event_type", F.col("total_files").alias("total"), F.col("converted_files").alias("converted"), F.col("failed_files").alias("failed"), F.col("patients_with_gender").alias("with_value"))


@query(f"SELECT event_id, 'bad_item' AS error FROM events WHERE TRY_CAST({_NUMBER} AS INT) IS NULL")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.build_errors(_numbered(spark, sf_dir)).select(F.col("file").cast("long").alias("event_id"), "error")


@query(f"SELECT printf('P-%06d', conv_id) AS patient_id, printf('V-%06d-1', conv_id) AS visit_id, {_ROLE} AS role, length(text)::BIGINT AS n_chars FROM conversations")
def nested_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients assembled and laid flat again."""
    return stats.turns_flat(_nested(spark, sf_dir)).select("patient_id", "visit_id", "role", F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT {_ROLE} AS role, count(*)::BIGINT AS n_turns, count(DISTINCT conv_id)::BIGINT AS n_patients, sum(length(text))::BIGINT AS n_chars, max(turn)::BIGINT AS last_turn, round(median(length(text)), 2) AS median_chars FROM conversations GROUP BY 1")
def patient_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: what each role says."""
    return stats.role_profile(_turns(spark, sf_dir), "conv_id")


_ABOUT = "(SELECT conv_id, count(*) AS turns, (sum(length(text)) % 100)::INT AS age, (sum(length(text)) % 3)::INT AS n FROM conversations GROUP BY 1)"


def _map(key: str, table: str) -> str:
    return f"(SELECT string_agg(key || '=' || n, ',' ORDER BY key) FROM (SELECT {key} AS key, count(*) AS n FROM {table} GROUP BY 1))"


_BAND = "CASE WHEN n = 0 THEN 'unknown' WHEN age <= 12 THEN '0-12' WHEN age <= 17 THEN '13-17' WHEN age <= 44 THEN '18-44' WHEN age <= 59 THEN '45-59' ELSE '60+' END"
_TAKEN = ("(VALUES ('demographics.age_distribution.age_stats', 'valid ages'), ('visits_and_dialogue.visits_per_patient', 'visits of a patient'), "
          "('visits_and_dialogue.turns_per_visit', 'turns of a visit'), ('scales.gad7_total', 'valid GAD-7 totals'), ('scales.phq9_total', 'valid PHQ-9 totals')) m(path, what)")  # fmt: skip


@query(f"""WITH a AS {_ABOUT}, v AS (SELECT 'demographics.age_distribution.age_stats' AS path, age AS v FROM a WHERE n > 0 UNION ALL SELECT 'visits_and_dialogue.visits_per_patient', 1 FROM a UNION ALL SELECT 'visits_and_dialogue.turns_per_visit', turns FROM a),
s AS (SELECT path, what, count(v)::DOUBLE AS "count", round(avg(v), 2) AS mean, round(median(v), 2) AS median, min(v)::DOUBLE AS "min", max(v)::DOUBLE AS "max" FROM {_TAKEN} LEFT JOIN v USING (path) GROUP BY ALL)
SELECT path || '.' || stat AS metric, stat || ' of ' || what AS definition, CASE stat WHEN 'count' THEN "count" WHEN 'mean' THEN mean WHEN 'median' THEN median WHEN 'min' THEN "min" ELSE "max" END AS value, NULL::VARCHAR AS counts FROM s, (VALUES ('count'), ('mean'), ('median'), ('min'), ('max')) x(stat)
UNION ALL SELECT 'base.patient_count', 'patients', (SELECT count(*) FROM a), NULL UNION ALL SELECT 'base.patients_with_keywords', 'patients with a keyword', (SELECT count(*) FROM a WHERE n = 2), NULL UNION ALL SELECT 'base.patients_with_scales', 'patients with a scale record', 0, NULL
UNION ALL SELECT 'demographics.gender_distribution', 'patients by gender, unknown where missing', NULL, {_map("CASE n WHEN 0 THEN '男' WHEN 1 THEN '女' ELSE 'unknown' END", "a")}
UNION ALL SELECT 'demographics.age_distribution.age_buckets', 'patients by age band, unknown where missing', NULL, {_map(_BAND, "a")}
UNION ALL SELECT 'visits_and_dialogue.turn_role_distribution', 'turns by role', NULL, {_map(_ROLE, "conversations")}
UNION ALL SELECT 'scales.gad7_severity_distribution', 'GAD-7 totals by severity', NULL, '' UNION ALL SELECT 'scales.phq9_severity_distribution', 'PHQ-9 totals by severity', NULL, ''""")
def metric_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the summary's figures means, beside the figure: conversations are patients whose age, gender and keywords their texts' length gives."""
    chars = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(F.sum(F.length("text")).alias("c"))
    n = F.col("c") % 3
    about = {"age": F.when(n > 0, (F.col("c") % 100).cast("int")), "gender": F.when(n == 0, "男").when(n == 1, "女"), "keywords": F.when(n == 2, F.array(F.lit("k")))}
    return stats.explained(stats.summary(_nested(spark, sf_dir).join(chars, "file_id").withColumns(about)))
