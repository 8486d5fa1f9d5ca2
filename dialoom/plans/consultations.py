"""Queries that make consultations of the driver's tables and run the whole operators over them, with SQL for the same rows.

A conversation becomes a transcript, its user the patient, its assistant the doctor, its system the caregiver; the
customers become a score sheet, pages photos.
"""

from __future__ import annotations

import base64
import json
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clinical
from ..operators import audit, dataset, dialogue, masking, ocr, scales, speakers, stats
from ..sources import files, sinks, trees
from ..streaming import photos
from .build import build
from .registry import EMAIL, query, read, spread

_FLAT = "replace(text, chr(10), ' ')"
_TURN = f"(SELECT conv_id, turn, role, {_FLAT} AS flat FROM conversations)"


def _transcripts(spark: SparkSession, sf_dir: str, *parts: Column) -> DataFrame:
    """conv_id and text: the lines that parts (null: none) give for each turn, in order."""
    # as many parts as a shuffle has, however few bytes they hold: what follows is heavy for each dialogue
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = read(spark, sf_dir, "conversations").repartition(n, "conv_id").withColumn("flat", F.translate("text", "\n", " "))
    line = F.struct("turn", F.concat_ws("\n", *parts).alias("line"))
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("x"))
    return by.select("conv_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


def _by_role(user: str, assistant: str, system: str) -> Column:
    return F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(system)


def _dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole dialogue texts: a keyword block, turns, every third with a further line, a separator after every fourth."""
    said = F.concat(_by_role("[患者]", "[医生]", "【P2（妈妈家属）】"), F.lit("："), "flat")
    more = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("续"), F.col("turn").cast("string")))
    apart = F.when(F.col("turn") % 4 == 3, F.element_at(F.array(F.lit("OUT"), F.lit("出去"), F.lit("（离开）")), (F.col("conv_id") % 3 + 1).cast("int")))
    t = _transcripts(spark, sf_dir, said, more, apart)
    head = F.concat(F.lit("关键词:\nk"), F.col("conv_id").cast("string"), F.lit("、二、，\n\n文字记录:\n"))
    return t.withColumn("text", F.concat(head, "text"))


@query(f"""WITH t AS (SELECT conv_id, turn, replace({_FLAT}, 'OUT', 'out') AS flat FROM conversations)
SELECT conv_id, (2 * ((turn + 1) // 3) + 1)::INT AS visit_no, count(*)::INT AS n_turns, md5(string_agg(CASE turn % 3 WHEN 1 THEN 'patient:' ELSE 'doctor:' END || flat, '|' ORDER BY turn)) AS digest FROM t GROUP BY ALL
UNION ALL SELECT conv_id, (2 * (turn // 3) + 2)::INT, 0, md5('') FROM t WHERE turn % 3 = 1""")
def inline_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separators within lines: what stands before one ends a visit, what stands after it opens the next, which has no turns if that holds no marker."""
    flat = F.replace("flat", F.lit("OUT"), F.lit("out"))
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("[医生]："), flat)).when(F.col("turn") % 3 == 1, F.concat(F.lit("[患者]："), flat, F.lit("OUT尾OUT"))).otherwise(F.concat(F.lit("[医生]："), flat))
    apart = F.when(F.col("turn") % 3 == 1, F.lit("出去"))
    parsed = dialogue.parse(_transcripts(spark, sf_dir, line, apart)).select("conv_id", F.inline("visits"))
    said = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])), "|")
    return parsed.select("conv_id", "visit_no", F.size("turns").alias("n_turns"), F.md5(said).alias("digest"))


#: The turns that a dialogue is to give: from the first doctor's on, visits of four numbers each.
_TURNS = f"""(WITH t AS (SELECT *, coalesce(min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id), 0) AS first FROM {_TURN}),
v AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn // 4) AS visit_no FROM t WHERE turn >= first)
SELECT conv_id, visit_no::INT AS visit_no, (row_number() OVER (PARTITION BY conv_id, visit_no ORDER BY turn))::INT AS turn_no,
    CASE role WHEN 'user' THEN 'patient' WHEN 'assistant' THEN 'doctor' ELSE 'caregiver' END AS role,
    flat || CASE WHEN turn % 3 = 0 THEN '续' || turn ELSE '' END AS said, CASE WHEN role NOT IN ('user', 'assistant') THEN '妈妈家属' END AS speaker_note FROM v)"""


@query(f"SELECT conv_id, visit_no, turn_no, role, md5(said) AS digest, speaker_note FROM {_TURNS}")
def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword block and label taken off, cut to the first doctor, split into visits and turns."""
    t = dialogue.turn_table(dialogue.parse(_dialogues(spark, sf_dir)), "conv_id")
    return t.select("conv_id", "visit_no", "turn_no", "role", F.md5("text").alias("digest"), "speaker_note")


@query("SELECT DISTINCT conv_id, 'k' || conv_id || '|二' AS keywords FROM conversations")
def dialogue_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dialogues(spark, sf_dir).select("conv_id", F.array_join(dialogue.keywords(F.col("text")), "|").alias("keywords"))


def _labelled(texts: DataFrame, stem: Column | None = None) -> DataFrame:
    done = speakers.label(texts.withColumn("stem", F.lit("1x") if stem is None else stem), "conv_id")
    return done.select("conv_id", F.md5("text_out").alias("digest"), "changed", "explicit_turns", "heuristic_turns")


def _explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(_transcripts(spark, sf_dir, F.concat(_by_role("【P（妈妈）】：", "【D1】", "【P患者】 "), "flat")))


def _alternating(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    opener = F.when((turn == 0) & (conv % 3 == 0), "医生你好").otherwise("")
    cue = F.when((turn == 0) & (conv % 7 == 0), "孩子").otherwise("")
    texts = _transcripts(spark, sf_dir, F.concat(opener, cue, "flat"), F.when(turn % 4 == 1, F.lit("关键词")), F.when(turn % 5 == 0, F.lit("2030年1月2日")))
    return _labelled(texts, F.concat(F.lit("x "), (conv % 40).cast("string"), F.lit("岁")))


_EXPLICIT = f"""SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN '[患者家属]：' WHEN 'assistant' THEN '[医生]：' ELSE '[患者]：' END || flat, chr(10) ORDER BY turn)) AS digest,
    true AS changed, count(*)::BIGINT AS explicit_turns, 0::BIGINT AS heuristic_turns FROM {_TURN} GROUP BY 1"""
_ALTERNATING = f"""SELECT conv_id, md5(string_agg(CASE WHEN (nth + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END) % 2 = 1 THEN '[医生]：' WHEN conv_id % 40 < 18 OR conv_id % 7 = 0 THEN '[患者家属]：' ELSE '[患者]：' END
    || CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN '医生你好' ELSE '' END || CASE WHEN turn = 0 AND conv_id % 7 = 0 THEN '孩子' ELSE '' END || flat
    || CASE WHEN turn % 4 = 1 THEN chr(10) || '关键词' ELSE '' END || CASE WHEN turn % 5 = 0 THEN chr(10) || '2030年1月2日' ELSE '' END, chr(10) ORDER BY turn)) AS digest,
    true AS changed, 0::BIGINT AS explicit_turns, count(*)::BIGINT AS heuristic_turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM {_TURN}) GROUP BY 1"""


@query(_EXPLICIT)
def explicit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenticular D and P labels in the square form."""
    return _explicit(spark, sf_dir)


@query(f"""SELECT conv_id, md5(string_agg(label || '：' || flat, chr(10) ORDER BY turn)) AS digest, true AS changed, count(*) FILTER (WHERE turn % 3 <> 1)::BIGINT AS explicit_turns, 0::BIGINT AS heuristic_turns
FROM (SELECT *, last_value(CASE WHEN turn % 3 <> 1 THEN CASE role WHEN 'user' THEN '[患者]' WHEN 'assistant' THEN '[医生]' ELSE '[患者家属]' END END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM {_TURN}) GROUP BY 1""")
def carried_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a role alone: it is carried to the lines after it."""
    return _labelled(_transcripts(spark, sf_dir, F.when(F.col("turn") % 3 != 1, _by_role("患者", "医生：", " 家属1: ")), F.col("flat")))


@query(_ALTERNATING)
def alternating_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two speakers in turn: openers, cues and ages decide who begins and who the other is; headers and dates are skipped."""
    return _alternating(spark, sf_dir)


@query(f"""SELECT count(*)::BIGINT AS files_total, count(*) FILTER (WHERE changed)::BIGINT AS files_changed, count(*) FILTER (WHERE explicit_turns > 0)::BIGINT AS files_explicit,
    count(*) FILTER (WHERE heuristic_turns > 0)::BIGINT AS files_heuristic, sum(explicit_turns)::BIGINT AS explicit_turns, sum(heuristic_turns)::BIGINT AS heuristic_turns FROM ({_EXPLICIT} UNION ALL {_ALTERNATING})""")
def label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.label_counts(_explicit(spark, sf_dir).unionByName(_alternating(spark, sf_dir)))


#: Lines with what the labelling rules are to say of them.
_RULES = """(VALUES (0, '【D】 你好', '[医生]：你好', NULL, false, false, false, '[患者]'), (1, '【P孩子】：嗯', '[患者家属]：嗯', NULL, false, false, false, '[患者家属]'),
    (2, '【P 患者妈妈】好', '[患者家属]：好', NULL, false, false, false, '[患者]'), (3, '【护士】x', NULL, NULL, false, false, false, '[患者]'), (4, '　医生 ：', NULL, '[医生]', false, true, true, '[患者]'),
    (5, '家属12', NULL, '[患者家属]', false, false, false, '[患者]'), (6, '文字记录:', NULL, NULL, true, true, false, '[患者]'), (7, '录于 2030年 1月2日', NULL, NULL, true, true, false, '[患者]'),
    (8, '你好，医生', NULL, NULL, false, false, true, '[患者]'), (9, '请问医生', NULL, NULL, false, false, true, '[患者]'), (10, '我儿子咳', NULL, NULL, false, false, false, '[患者家属]'), (11, ' ', NULL, NULL, true, true, false, '[患者]'),
    (12, '我孙女', NULL, NULL, false, false, false, '[患者家属]'), (13, '他爸爸', NULL, NULL, false, false, false, '[患者家属]'), (14, '家里', NULL, NULL, false, false, false, '[患者家属]'), (15, '医生：我', NULL, NULL, false, false, true, '[患者]'),
    (16, '患者', NULL, '[患者]', false, false, false, '[患者]'), (17, '我家孩子', NULL, NULL, false, false, false, '[患者家属]'), (18, '问我女儿', NULL, NULL, false, false, false, '[患者家属]'), (19, '我孙子呢', NULL, NULL, false, false, false, '[患者家属]'),
    (20, '他妈妈说', NULL, NULL, false, false, false, '[患者家属]'), (21, '孩子', NULL, NULL, false, false, false, '[患者家属]'))"""
_RULE_LINES = re.findall(r"\(\d+, '([^']*)'", _RULES)


@query(f"SELECT p_partkey, bracket, role_line, meta, skipped, opener, CASE WHEN p_size < 18 THEN '[患者家属]' ELSE other END AS other FROM part JOIN {_RULES} r(n, line, bracket, role_line, meta, skipped, opener, other) ON round(p_retailprice * 100)::BIGINT % 22 = n")
def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules for single lines, all nine cues among them; a part's price chooses the line, its size is the age."""
    line = F.element_at(F.array(*map(F.lit, _RULE_LINES)), (F.round(F.col("p_retailprice") * 100).cast("long") % len(_RULE_LINES) + 1).cast("int"))
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size", line.alias("line"))
    x = F.col("line")
    return df.select("p_partkey", speakers.bracket_label(x).alias("bracket"), speakers.role_line(x).alias("role_line"), speakers.is_meta(x).alias("meta"), speakers.is_skipped(x).alias("skipped"), speakers.is_patient_opener(x).alias("opener"), speakers.other_side(F.col("p_size"), x).alias("other"))


@query("""SELECT k, CASE n WHEN 0 THEN k::VARCHAR WHEN 1 THEN k || ',' || (k + 1) WHEN 2 THEN k::VARCHAR WHEN 4 THEN '12' END AS ids, CASE n WHEN 3 THEN NULL WHEN 4 THEN '3' ELSE '[N]' END AS name,
    CASE n WHEN 1 THEN '男' WHEN 2 THEN '女' END AS gender, CASE n WHEN 1 THEN (k % 90)::INT END AS age, CASE n WHEN 1 THEN (k % 90)::INT END AS age_in_stem,
    CASE n WHEN 0 THEN k::VARCHAR WHEN 1 THEN k || ',' || (k + 1) WHEN 2 THEN k::VARCHAR WHEN 3 THEN '' ELSE '123' END AS prefix_ids FROM (SELECT c_custkey + 1 AS k, floor(abs(c_acctbal))::BIGINT % 5 AS n FROM customer)""")
def title_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File stems of every form, as a customer's balance chooses: ids and a name, several ids, a gender, an age, no id, digits alone."""
    k, n = (F.col("c_custkey") + 1).cast("string"), F.floor(F.abs("c_acctbal")).cast("long") % 5
    many = F.concat(k, F.lit("，"), (F.col("c_custkey") + 2).cast("string"), F.lit(" [N] 男 "), ((F.col("c_custkey") + 1) % 90).cast("string"), F.lit("岁"))
    stem = F.when(n == 0, F.concat(k, F.lit("[N]"))).when(n == 1, many).when(n == 2, F.concat(k, F.lit(" [N] 女"))).when(n == 3, F.lit("[N]")).otherwise("123")
    df = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("k"), stem.alias("stem"))
    t = df.withColumns({"t": clinical.title(F.col("stem")), "p": clinical.prefix_ids(F.col("stem")), "age_in_stem": clinical.age_in_stem(F.col("stem"))})
    return t.select("k", F.array_join("t.ids", ",").alias("ids"), "t.name", "t.gender", "t.age", "age_in_stem", F.array_join("p", ",").alias("prefix_ids"))


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a score sheet of strings; the third item of every eleventh is no number."""
    item = lambda letter, i: F.when((F.col("c_custkey") % 11 == 0) & F.lit(letter == "G" and i == 3), "n/a").otherwise(((F.col("c_custkey") + i) % 4).cast("string"))
    columns = [item(letter, i).alias(f"{letter}{i}. {scales.ITEM_PHRASE}，x") for letter, n in scales.SCALES.values() for i in range(1, n + 1)]
    return read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).cast("string").alias(scales.ID_COLUMN), *columns)


_SCORES = "(SELECT c_custkey + 1 AS id, list_sum([(c_custkey + i) % 4 for i in range(1, 8)])::INT AS gad7, list_sum([(c_custkey + i) % 4 for i in range(1, 10)])::INT AS phq9, c_custkey % 11 = 0 AS bad FROM customer)"


@query(f"""SELECT o_orderkey, CASE WHEN bool_or(bad) THEN NULL ELSE coalesce(string_agg(gad7 || '/' || phq9, ',' ORDER BY id), '') END AS totals, CASE WHEN bool_or(bad) THEN 'bad_item' END AS scale_error
FROM orders LEFT JOIN {_SCORES} ON id IN (o_custkey + 1, o_custkey + 2) GROUP BY 1""")
def scale_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score records of files with two ids, in the sheet's order; a bad row is an error of its files."""
    wanted = read(spark, sf_dir, "orders").select("o_orderkey", F.transform(F.array("o_custkey", F.col("o_custkey") + 1, F.col("o_custkey")), lambda x: (x + 1).cast("int")).alias("ids"))
    found = scales.lookup(wanted, scales.scale_rows(_sheet(spark, sf_dir)), "o_orderkey")
    one = lambda s: F.concat_ws("/", s["GAD-7"]["total"].cast("string"), s["PHQ-9"]["total"].cast("string"))
    return found.select("o_orderkey", F.when(F.col("scale_error").isNull(), F.array_join(F.transform("scales", one), ",")).alias("totals"), "scale_error")


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build over the dialogues: every fifth file has a bad title, the next to it bytes that are no text."""
    n, k = F.col("conv_id") % 5, (F.col("conv_id") + 1).cast("string")
    who = F.when(F.col("conv_id") % 3 == 0, " 男").when(F.col("conv_id") % 3 == 1, " 女 30岁").otherwise("")
    rows = _dialogues(spark, sf_dir).select(
        F.col("conv_id").alias("file_id"), F.concat(F.lit("in/"), k, F.lit(".txt")).alias("path"), F.when(n == 0, "[N]").otherwise(F.concat(k, F.lit(" [N]"), who)).alias("stem"),
        F.when(n != 1, F.col("text")).alias("text"), F.when(n == 1, "bad_utf8").alias("error"),
    )
    return build(rows, _sheet(spark, sf_dir))


_ERRORS = "CASE WHEN conv_id % 5 = 0 THEN 'bad_title' WHEN conv_id % 5 = 1 THEN 'bad_utf8' WHEN conv_id % 11 = 0 AND conv_id IN (SELECT c_custkey FROM customer) THEN 'bad_item' END"
_FILES = f"(SELECT conv_id, {_ERRORS} AS error, v.n_visits, s.id IS NOT NULL AS scored FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, max(visit_no) AS n_visits FROM {_TURNS} GROUP BY 1) v USING (conv_id) LEFT JOIN {_SCORES} s ON s.id = conv_id + 1)"


@query(f"SELECT conv_id AS file_id, error, CASE WHEN error IS NULL THEN printf('P-%06d', conv_id + 1) END AS patient_id, CASE WHEN error IS NULL THEN n_visits::INT END AS n_visits, CASE WHEN error IS NULL THEN scored::INT END AS n_scales FROM {_FILES}")
def build_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: a row for each file, failed ones with their error alone."""
    return _built(spark, sf_dir).select("file_id", "error", "patient_id", F.when(F.col("visits").isNotNull(), F.size("visits")).alias("n_visits"), F.when(F.col("scales").isNotNull(), F.size("scales")).alias("n_scales"))


@query(f"""SELECT count(*)::BIGINT AS total_files, count(*) FILTER (WHERE error IS NULL)::BIGINT AS converted_files, count(error)::BIGINT AS failed_files, count(*) FILTER (WHERE error IS NULL)::BIGINT AS patients_with_keywords,
    count(*) FILTER (WHERE error IS NULL AND conv_id % 3 < 2)::BIGINT AS patients_with_gender, count(*) FILTER (WHERE error IS NULL AND conv_id % 3 = 1)::BIGINT AS patients_with_age, count(*) FILTER (WHERE error IS NULL AND scored)::BIGINT AS patients_with_scales,
    sum(n_visits) FILTER (WHERE error IS NULL)::BIGINT AS total_visits, string_agg(CASE WHEN error IS NOT NULL THEN 'in/' || (conv_id + 1) || '.txt=' || error END, ',' ORDER BY 'in/' || (conv_id + 1) || '.txt') AS errors FROM {_FILES}""")
def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = dataset.build_counts(_built(spark, sf_dir))
    return counts.withColumn("errors", F.array_join(F.transform("errors", lambda e: F.concat_ws("=", e["file"], e["error"])), ","))


@query(f"""SELECT count(*)::BIGINT AS patient_count, count(*) FILTER (WHERE scored)::BIGINT AS patients_with_scales, count(*) FILTER (WHERE conv_id % 3 = 0)::BIGINT AS men, count(*) FILTER (WHERE conv_id % 3 = 1)::BIGINT AS women, count(*) FILTER (WHERE conv_id % 3 = 2)::BIGINT AS unknown,
    count(*) FILTER (WHERE conv_id % 3 = 1)::BIGINT AS adults, round(avg(n_visits), 2) AS mean_visits, max(n_visits)::INT AS most_visits,
    (SELECT count(*) FROM {_TURNS} t JOIN {_FILES} f USING (conv_id) WHERE f.error IS NULL AND t.role = 'doctor')::BIGINT AS doctor_turns FROM {_FILES} WHERE error IS NULL""")
def summary_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the summary; failed files are no patients."""
    s = stats.summary(_built(spark, sf_dir))
    gender, role = F.col("demographics.gender_distribution"), F.col("visits_and_dialogue.turn_role_distribution")
    many = lambda m, key: F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(0))
    return s.select(
        "base.patient_count", "base.patients_with_scales", many(gender, "男").alias("men"), many(gender, "女").alias("women"), many(gender, "unknown").alias("unknown"),
        many(F.col("demographics.age_distribution.age_buckets"), "18-44").alias("adults"), F.col("visits_and_dialogue.visits_per_patient.mean").alias("mean_visits"),
        F.col("visits_and_dialogue.visits_per_patient.max").cast("int").alias("most_visits"), many(role, "doctor").alias("doctor_turns"),
    )


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one where Spark runs on one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set")
    return f"{shared.rstrip('/') if shared else 'file://' + os.path.join(tempfile.gettempdir(), 'dialoom-shared')}/consultations-{uuid.uuid4().hex}"


@query(f"""SELECT printf('P-%06d', conv_id + 1) AS patient_id, (conv_id + 1) || '.txt' AS source_file, n_visits::INT AS n_visits, (SELECT count(*) FROM {_FILES})::BIGINT AS source_total_files,
    (SELECT count(*) FROM {_FILES} WHERE error IS NULL)::BIGINT AS source_converted_files FROM {_FILES} WHERE error IS NULL""")
def document_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset as one JSON document that tasks write in parts, read back part by part."""
    path = _scratch(spark)
    sinks.tables(_built(spark, sf_dir), f"{path}/table")
    sinks.ordered_document(spark.read.parquet(f"{path}/table"), f"{path}/document", "in")
    back = files.document_patients(spark, f"{path}/document")
    return back.select("patient_id", F.col("path").alias("source_file"), F.size("visits").alias("n_visits")).crossJoin(files.document_meta(spark, f"{path}/document").drop("schema_version"))  # one row


_FAULTY = """(SELECT conv_id, sum(length(text))::BIGINT % 5 AS kind, '{"stats": {"total_files": ' || count(*) || '}, "patients": [{"patient_id": "P-' || conv_id || '"' AS good FROM conversations GROUP BY 1)"""


@query(f"""SELECT conv_id, CASE kind WHEN 0 THEN 'empty_document' WHEN 1 THEN 'malformed_json' WHEN 2 THEN 'wrong_type' WHEN 3 THEN 'wrong_type' END AS error,
    CASE kind WHEN 1 THEN '1:' || (length(good) + 1) WHEN 2 THEN '$.patients[0].age' WHEN 3 THEN '$.patients[0].visits[1].dialogue.turns' END AS place, CASE kind WHEN 4 THEN 1 END::INT AS n_patients FROM {_FAULTY}""")
def faulty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each conversation, of which some are empty, cut off or hold values of other types: rows with a code and a place."""
    by = read(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")) % 5).alias("kind"), F.count("*").alias("n"))
    start = F.concat(F.lit('{"stats": {"total_files": '), F.col("n").cast("string"), F.lit('}, "patients": [{"patient_id": "P-'), F.col("conv_id").cast("string"), F.lit('"'))
    end = {2: ', "age": "ten"}]}', 3: ', "visits": [{}, {"dialogue": {"turns": "x"}}]}]}', 4: "}]}"}
    text = F.when(F.col("kind") == 0, " \n").when(F.col("kind") == 1, start)
    for kind, rest in end.items():
        text = text.when(F.col("kind") == kind, F.concat(start, F.lit(rest)))
    path = _scratch(spark)
    sinks.write_mirrored(by.select(F.format_string("%d.json", "conv_id").alias("rel_path"), text.alias("text")), path)
    good, bad = files.checked(spark, path, "*.json")
    conv = F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long").alias("conv_id")
    none = lambda kind: F.lit(None).cast(kind)
    return bad.select(conv, "error", "place", none("int").alias("n_patients")).unionByName(good.select(conv, none("string").alias("error"), none("string").alias("place"), F.size("patients").alias("n_patients")))


def _addresses(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "PER") for m in re.finditer(EMAIL, text)] if "@" in text else []


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.col("source"), F.when(F.col("doc_id") % 4 == 0, " a.b@c.de").otherwise(""))
    return masking.mask(spread(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", stem.alias("stem"), "text"), _addresses, key="doc_id")


_MASKED = f"(SELECT doc_id, source || CASE WHEN doc_id % 4 = 0 THEN ' [NAME]' ELSE '' END AS stem_out, regexp_replace(text, '{EMAIL}', '[NAME]', 'g') AS text_out, doc_id % 4 = 0 AS renamed, text FROM documents)"


@query(f"SELECT doc_id, stem_out, md5(text_out) AS digest, renamed, text_out <> text AS changed FROM {_MASKED}")
def mask_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line by line, names in texts and stems replaced; addresses stand for names."""
    return _masked(spark, sf_dir).select("doc_id", "stem_out", F.md5("text_out").alias("digest"), "renamed", "changed")


@query(f"SELECT count(*)::BIGINT AS files_output, count(*) FILTER (WHERE renamed)::BIGINT AS files_renamed, count(*) FILTER (WHERE text_out <> text)::BIGINT AS files_changed FROM {_MASKED}")
def mask_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mask_counts(_masked(spark, sf_dir))


@query("""SELECT doc_id, label, CASE WHEN regexp_matches(upper(label), 'PER|NAME') THEN 'NAME' WHEN contains(upper(label), 'ORG') THEN 'ORG' END AS kind
FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS label FROM documents) WHERE regexp_matches(label, '[ap][en]r|o[rn]|na')""")
def entity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' words that look somewhat like labels, as labels."""
    words = spread(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0))).alias("label")).distinct()
    return words.where(F.col("label").rlike("[ap][en]r|o[rn]|na")).select("doc_id", "label", masking.entity_kind(F.col("label")).alias("kind"))


def _answer(request: dict) -> tuple[int, str]:
    """A client without a service: what it says depends on the photo's size."""
    size = len(base64.b64decode(request["file"]))
    pages = [{"markdown": {"text": f"p{size}"}}, {"markdown": {"text": "q"}}] if size % 4 == 0 else []
    return {1: 500, 2: 404}.get(size % 4, 200), json.dumps({"result": {"layoutParsingResults": pages}})


def _as_it_is(content: bytes) -> bytes:
    return content


def _photos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages as photos, those that are done, and what the client said of the others."""
    images = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("stem"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    done = read(spark, sf_dir, "pages").where("page_id % 10 = 0").select(F.col("page_id").cast("string").alias("stem"))
    return images, done, ocr.call(ocr.pending(images, done), _answer, pause=0, pacing=0, prepare=_as_it_is)


_PHOTO = "(SELECT page_id, strlen(coalesce(html, '')) AS n, page_id % 10 = 0 AS done FROM pages)"


@query(f"SELECT page_id::VARCHAR AS stem, CASE n % 4 WHEN 0 THEN 'p' || n || chr(10) || 'q' WHEN 3 THEN '' END AS text, CASE n % 4 WHEN 0 THEN 'success' ELSE 'failed' END AS status FROM {_PHOTO} WHERE NOT done")
def ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos without a result yet, through a client; an answer without text fails."""
    return ocr.results(_photos(spark, sf_dir)[2])


@query(f"SELECT page_id::VARCHAR AS stem, CASE n % 4 WHEN 1 THEN 500 WHEN 2 THEN 404 ELSE 200 END::INT AS status_code, CASE n % 4 WHEN 1 THEN 3 ELSE 1 END::INT AS tries FROM {_PHOTO} WHERE NOT done")
def ocr_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status of 500 is tried again."""
    return _photos(spark, sf_dir)[2].select("stem", "status_code", "tries")


@query(f"SELECT count(*) FILTER (WHERE NOT done AND n % 4 = 0)::BIGINT AS success, count(*) FILTER (WHERE NOT done AND n % 4 <> 0)::BIGINT AS failed, count(*) FILTER (WHERE done)::BIGINT AS skipped FROM {_PHOTO}")
def ocr_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.counts(*_photos(spark, sf_dir))


@query(f"""WITH p AS (SELECT *, n % 4 = 1 AS again FROM {_PHOTO})
SELECT page_id::VARCHAR AS stem, CASE WHEN again THEN 3 ELSE 1 END::INT AS attempts, CASE WHEN n % 4 = 0 THEN 'success' ELSE 'failed' END AS status, CASE n % 4 WHEN 0 THEN 'p' || n || chr(10) || 'q' END AS text FROM p""")
def photo_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as photos that arrive in two rounds; those that the service couldn't take are tried again in later rounds, after which they have failed for good."""
    path, pages = _scratch(spark), read(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").cast("string").alias("path"), F.col("page_id").cast("string").alias("stem"), F.coalesce("html", F.lit("")).cast("binary").alias("content"), "page_id")
    again = lambda due: due.join(rows.select("stem", "content"), "stem")
    for number in range(4):
        came = rows.where(F.col("page_id") % 2 == number).drop("page_id") if number < 2 else None
        now = F.lit(f"2030-01-0{number + 1} 00:00:00").cast("timestamp")
        for _ in range(2):  # the second as after a restart: nothing is sent again
            photos.take(spark, came, path, _answer, str(number), now, again, pacing=0, prepare=_as_it_is)
    return photos.standing(photos.ledger(spark, path)).select("stem", "attempts", "status", "text")


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as two folders of files; every fifth customer's name begins with no id."""
    key = F.col("c_custkey").cast("string")
    c = read(spark, sf_dir, "customer").select(F.lit("c").alias("folder"), "c_name", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("x"), key)).otherwise(F.concat(key, F.lit("、"), key, F.lit(" ,1x"))).alias("stem"))
    s = read(spark, sf_dir, "supplier").select(F.lit("s"), "s_name", F.concat(F.col("s_suppkey").cast("string"), F.lit("y")))
    return audit.named_ids(c.union(s).toDF("folder", "name", "stem"))


@query("SELECT 'c' AS folder, c_name AS name FROM customer WHERE c_custkey % 5 = 0")
def names_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.without_ids(_stems(spark, sf_dir))


@query("SELECT c_custkey::INT AS id FROM customer WHERE c_custkey % 5 <> 0 UNION SELECT 1 UNION SELECT s_suppkey FROM supplier")
def ids_of_all_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.all_ids(_stems(spark, sf_dir))


@query("SELECT CASE WHEN c_mktsegment < 'B' THEN '男' WHEN c_mktsegment < 'H' THEN '女' ELSE 'unknown' END AS key, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def gender_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by what their segment stands for; an empty gender counts as unknown."""
    gender = F.when(F.col("c_mktsegment") < "B", "男").when(F.col("c_mktsegment") < "H", "女").otherwise("")
    return stats.distribution(read(spark, sf_dir, "customer"), F.nullif(gender, F.lit("")), "unknown")


def _tree(spark: SparkSession, sf_dir: str, name: Column) -> tuple[str, DataFrame | None]:
    """Conversations' turns as a tree of text files, a folder for each hundred conversations and one for each of these. Where it is, and what was left out."""
    path = _scratch(spark)
    rel = F.concat_ws("/", F.format_string("%06d", F.expr("conv_id div 100")), F.format_string("c%08d", "conv_id"), name)
    try:
        sinks.write_mirrored(read(spark, sf_dir, "conversations").select(rel.alias("rel_path"), "text"), path)
    except sinks.Collisions as left_out:
        return path, left_out.rows
    return path, None


_REL = "printf('%06d/c%08d/%04d %s.txt', conv_id // 100, conv_id, turn, role)"


def _by_turn() -> Column:
    return F.format_string("%04d %s.txt", "turn", "role")


@query(f"SELECT {_REL} AS rel_path, strlen(text)::BIGINT AS length, md5(text) AS digest FROM conversations")
def mirrored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each turn, written and read back: true paths, bytes as they are."""
    path, _ = _tree(spark, sf_dir, _by_turn())
    return trees.read(spark, path, "*.txt").select("rel_path", "length", F.md5("content").alias("digest"))


@query(f"SELECT {_REL} AS rel_path, row_number() OVER (ORDER BY {_REL}) AS nth FROM conversations WHERE role = 'user'")
def files_in_path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one name pattern, numbered in the order of their paths, which partitions of even bytes keep."""
    path, _ = _tree(spark, sf_dir, _by_turn())
    return trees.read(spark, path, "* user.txt", partition_bytes=4 << 20, numbered=True).select("rel_path", "nth")


@query("SELECT printf('%06d/c%08d/%s.txt', conv_id // 100, conv_id, role) AS rel_path, count(*)::BIGINT AS n, CASE WHEN count(*) > 1 THEN 'collision' END AS error, CASE WHEN count(*) = 1 THEN md5(any_value(text)) END AS digest FROM conversations GROUP BY 1")
def mirrored_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by role alone: those of several turns are reported and not written, the others are."""
    path, left_out = _tree(spark, sf_dir, F.concat("role", F.lit(".txt")))
    done = trees.read(spark, path).select("rel_path", F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("error"), F.md5("content").alias("digest"))
    return done if left_out is None else done.unionByName(left_out.withColumn("digest", F.lit(None).cast("string")))
