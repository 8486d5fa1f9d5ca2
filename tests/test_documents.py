"""Documents in parts, byte for byte those in one row, and documents that are none."""

import json
import os

import pytest

from dialoom.__main__ import main
from dialoom.operators import dataset
from dialoom.sources import files, sinks

TURN = "struct<role:string,text:string,speaker_note:string>"
SCALE = "struct<items:array<int>,total:int>"
DDL = f"file_id long, path string, error string, patient_id string, name string, gender string, age int, keywords array<string>, scales array<struct<respondent_role:string,`GAD-7`:{SCALE},`PHQ-9`:{SCALE}>>, visits array<struct<visit_id:string,dialogue:struct<source_file:string,turns:array<{TURN}>>>>"


def rows(n, failing=7):
    out = []
    for i in range(n):
        if failing and i % failing == 0:
            out.append((i, f"in/{i}.txt", "bad_title", None, None, None, None, None, None, None))
            continue
        turns = [("doctor", 'a "quoted"\n] , {\n "errors" : [ ]', None), ("caregiver" if i % 3 else "patient", "、x", "妈妈")]
        visits = [(f"V-{i:06}-{k}", (f"{i}.txt", turns[: i % 3])) for k in range(i % 4)]
        out.append((i, f"in/{i}.txt", None, f"P-{(i * 37) % n:06}", f"n{i}", "男" if i % 2 else None, i % 90 if i % 5 else None, ["甲", "乙"][: i % 3], [("self", ([1, 2], 3), ([], 0))] * (i % 2), visits))
    return out


def text_of(spark, df):
    return "\n".join(r.value for r in df.collect())


@pytest.mark.parametrize(("n", "failing", "split"), [(200, 7, None), (200, 0, None), (7, 1, None), (0, 0, None), (200, 7, "with_caregiver"), (3, 1, "without_caregiver")])
def test_parts_make_the_same_bytes(spark, tmp_path, n, failing, split):
    patients = spark.createDataFrame(rows(n, failing), DDL).repartition(5)
    args = (split, 200, 150) if split else ()
    sinks.ordered_document(patients, f"file://{tmp_path}/d", 'here "errors" : [ ]', *args)
    sinks.join_document(spark, f"file://{tmp_path}/d", f"file://{tmp_path}/whole.json")
    got = (tmp_path / "whole.json").read_text(encoding="utf-8")
    one_row = dataset.document(patients, 'here "errors" : [ ]', *args).first()
    assert (one_row is None and split) or got == one_row.value  # a split that nobody is in has no row there
    whole = json.loads(got)
    assert len(whole["patients"]) == sum(r[2] is None for r in rows(n, failing))
    back = files.document_patients(spark, f"file://{tmp_path}/d")
    assert sorted(r.patient_id for r in back.collect()) == sorted(p["patient_id"] for p in whole["patients"])
    meta = files.document_meta(spark, f"file://{tmp_path}/d").first()
    assert meta.source_total_files == (0 if split else n)


def test_several_parts_without_collected_lists(spark, tmp_path):
    patients = spark.createDataFrame(rows(300), DDL)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.ordered_document(patients, f"{tmp_path}/d", "here")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([x for x in os.listdir(f"{tmp_path}/d/patients") if x.startswith("part-")]) > 1
    sinks.join_document(spark, f"{tmp_path}/d", f"{tmp_path}/whole.json")
    assert (tmp_path / "whole.json").read_text(encoding="utf-8") == dataset.document(patients, "here").first().value
    plan = dataset.document_pieces(dataset.converted(patients), dataset.RECORD, 1, "patient_id")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "rangepartitioning" in plan


FAULTY = {
    "trunc": ('{"stats": {},\n"patients": [{"patient_id": "P-1", "age": 3', "malformed_json", "2:44"), "empty": ("", "empty_document", None), "space": (" \n", "empty_document", None),
    "list": ('[{"stats": {}}]', "wrong_type", "$"), "age": ('{"patients": [{"age": 1}, {"age": "x"}]}', "wrong_type", "$.patients[1].age"), "object": ('{"patients": {"a": 1}}', "wrong_type", "$.patients"),
    "scalar": ("5", "wrong_type", "$"), "bytes": (b'{"a": "\xff"}', "malformed_json", "byte 7"), "bool": ('{"stats": {"total_files": true}}', "wrong_type", "$.stats.total_files"), "null": ("null", "malformed_json", None),
    "good": ('{"stats": {"total_files": 2}, "patients": [{"patient_id": "P-1", "age": null, "more": 1}]}', None, None), "bare": (' \t{}', None, None),
}


def test_faulty_documents(spark, tmp_path, capsys):
    for name, (text, _, _) in FAULTY.items():
        (tmp_path / f"{name}.json").write_bytes(text if isinstance(text, bytes) else text.encode())
    good, bad = files.checked(spark, str(tmp_path))
    name = lambda r: os.path.basename(r.path).removesuffix(".json")
    assert {name(r): (r.error, r.place) for r in bad.collect()} == {n: f[1:] for n, f in FAULTY.items() if f[1]}
    assert sorted(map(name, good.collect())) == ["bare", "good"]
    assert [r.patient_id for r in files.patients_of(good).collect()] == ["P-1"]
    assert main(["stats", str(tmp_path)]) == 1
    said = capsys.readouterr()
    assert json.loads(said.out)["base"]["patient_count"] == 1 and len(said.err.strip().splitlines()) >= 10
