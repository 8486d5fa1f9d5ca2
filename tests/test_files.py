"""Files of dialogues, sheets, sinks, the stream and the OCR client on small invented inputs."""

import json
import os
import re

import pytest

from dialoom.__main__ import main
from dialoom.operators import audit, dataset, dialogue, masking, ocr, speakers, stats
from dialoom.plans.build import build, build_folder
from dialoom.sources import files, sinks
from dialoom.streaming import ingest

DIALOGUE = """2030年1月2日 上午 9:00|3分钟 5秒

关键词:
甲、乙、丙、

文字记录:

[医生]：第一句。
[患者]：第二句，
续行。
OUT
[医生]：第三句。
[患者家属]：第四句。
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("in") / "dialogues"
    top.mkdir()
    (top / "9 [NAME] 男 34岁.txt").write_text(DIALOGUE, encoding="utf-8")
    (top / "12，13 [NAME] 女 6岁.txt").write_bytes("[医生]：问\r\n[患者]：答\r\n".encode())
    (top / "[NAME].txt").write_text("x", encoding="utf-8")
    (top / "7[NAME].txt").write_bytes(b"\xff\xfe\xff")
    (top / "notes.md").write_text("no dialogue", encoding="utf-8")
    return str(top)


def by_first_id(patients):
    return {(r.ids or [None])[0]: r for r in patients.collect()}


def test_text_files(spark, folder):
    rows = {r.stem: r for r in files.text_files(spark, [folder, f"{folder}/missing"]).collect()}
    assert set(rows) == {"9 [NAME] 男 34岁", "12，13 [NAME] 女 6岁", "[NAME]", "7[NAME]"}
    assert rows["12，13 [NAME] 女 6岁"].text == "[医生]：问\n[患者]：答\n"
    assert rows["7[NAME]"].text is None and rows["7[NAME]"].error == "bad_utf8"
    assert files.text_files(spark, f"{folder}/missing").count() == 0


def test_empty_files_are_files(spark, tmp_path):
    (tmp_path / "5x.txt").touch()
    (row,) = files.text_files(spark, str(tmp_path)).collect()
    assert (row.stem, row.text, row.error) == ("5x", "", None)
    (built,) = build_folder(spark, str(tmp_path)).collect()
    assert (built.patient_id, built.visits, built.error) == ("P-000005", [], None)


def test_build_folder(spark, folder):
    rows = by_first_id(build_folder(spark, folder))
    man, child = rows[9], rows[12]
    assert (man.patient_id, man.gender, man.age, man.keywords, man.error) == ("P-000009", "男", 34, ["甲", "乙", "丙"], None)
    assert [v.visit_id for v in man.visits] == ["V-000009-1", "V-000009-2"]
    turns = [[(t.role, t.text) for t in v.dialogue.turns] for v in man.visits]
    assert turns == [[("doctor", "第一句。"), ("patient", "第二句，续行。")], [("doctor", "第三句。"), ("caregiver", "第四句。")]]
    assert (child.ids, child.age, child.keywords, len(child.visits)) == ([12, 13], 6, None, 1)
    assert rows[None].error == "bad_title" and rows[7].error == "bad_utf8" and rows[7].visits is None


def sheet_rows(spark, answers):
    names = ["序号", *[f"G{i}. 在过去2个星期" for i in range(1, 8)], *[f"P{i}. 在过去2个星期" for i in range(1, 10)]]
    return spark.createDataFrame(answers, ", ".join(f"`{n}` string" for n in names))


def test_build_with_a_sheet(spark, folder, tmp_path):
    answers = sheet_rows(spark, [("9", *"1111111", *"222222222"), ("12", *"0000000", *"000000001"), ("13", *"3333333", *"333333333")])
    path = f"{tmp_path}/sheet.csv"
    answers.coalesce(1).write.option("header", "true").csv(path)
    rows = by_first_id(build_folder(spark, folder, path))
    assert [(s["GAD-7"].total, s["PHQ-9"].total) for s in rows[9].scales] == [(7, 18)]
    assert [s["PHQ-9"].total for s in rows[12].scales] == [1, 27]
    bare = build(files.text_files(spark, folder), answers.drop("G1. 在过去2个星期"))
    assert by_first_id(bare)[9].error == "no_column"


def test_counts_and_document(spark, folder, tmp_path):
    patients = build_folder(spark, folder)
    counts = dataset.build_counts(patients).first()
    assert (counts.total_files, counts.converted_files, counts.failed_files, counts.total_visits) == (4, 2, 2, 3)
    assert sorted(e.error for e in counts.errors) == ["bad_title", "bad_utf8"]
    sinks.split_documents(patients, f"{tmp_path}/split", "here")
    for name, pid in (("with_caregiver", "P-000009"), ("without_caregiver", "P-000012")):
        text = "\n".join(r.value for r in spark.read.option("wholetext", "true").text(f"{tmp_path}/split/{name}").collect())
        found = json.loads(text)
        assert found["dataset_meta"]["split"] == name
        assert pid in [p["patient_id"] for p in found["patients"]]
    sinks.one_document(dataset.document(patients, "here"), f"{tmp_path}/whole")
    back = files.dataset(spark, f"{tmp_path}/whole")
    assert [r.patient_id for r in files.patients_of(back).collect()] == ["P-000009", "P-000012"]
    meta = files.meta_of(back).first()
    assert (meta.schema_version, meta.source_total_files, meta.source_converted_files) == (dataset.SCHEMA_VERSION, 4, 2)


def test_tables(spark, folder, tmp_path):
    patients = build_folder(spark, folder)
    sinks.tables(patients, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    sinks.split_tables(dataset.split(patients), f"{tmp_path}/s")
    assert sorted(x for x in os.listdir(f"{tmp_path}/s") if x.startswith("split=")) == ["split=with_caregiver", "split=without_caregiver"]
    texts = spark.createDataFrame([("a/x.txt", "1"), ("a/x.txt", "2"), ("b/y.txt", "3")], "rel_path string, text string")
    assert sorted((r.rel_path, r.error) for r in sinks.mirrored(texts).collect() if r.error) == [("a/x.txt", "collision")] * 2


def test_stream_takes_each_file_once(spark, folder, tmp_path):
    source = tmp_path / "arriving"
    source.mkdir()
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for n, stem in ((1, "9 [NAME] 男 34岁"), (2, "12，13 [NAME] 女 6岁")):
        with open(f"{folder}/{stem}.txt", "rb") as f:
            (source / f"{stem}.txt").write_bytes(f.read())
        ingest.ingest(spark, str(source), out, checkpoint).awaitTermination()
        assert spark.read.parquet(out).count() == n
    assert sorted(r.patient_id for r in spark.read.parquet(out).collect()) == ["P-000009", "P-000012"]


def test_visits_and_turns(spark):
    def visits(text):
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(dialogue.visits(df.t).alias("v")).first().v

    assert visits("OUT\na\nOUT\n出去\nb\n（走）\n(x)\nc\nOUT") == ["a", "b", "c"]
    assert visits("好OUT\nOUT好\naOUTb") == ["好", "好\na", "b"]
    df = spark.createDataFrame([("前\n[D1]一\n【P2（妈妈）】：二\n三\n[医生】四\n[护士]：五\n[患者]：",)], "t string")
    turns = df.select(dialogue.turns(df.t).alias("v")).first().v
    assert [t.text for t in turns] == ["一", "二三", "四", "五"]
    assert [t.role for t in turns] == ["doctor", "patient", "doctor", "other"]
    assert [t.speaker_note for t in turns] == [None, "妈妈", None, None]


def label(spark, stem, text):
    return speakers.label(spark.createDataFrame([(1, stem, text)], "file_id long, stem string, text string")).first()


def test_speaker_labels(spark):
    bracket = label(spark, "1x", "【D】你好\n【P（妈妈）】：好\n【P孩子】嗯\n【护士】x")
    assert bracket.text_out == "[医生]：你好\n[患者家属]：好\n[患者家属]：嗯\n【护士】x"
    carried = label(spark, "1x", "医生：\na\n【P】b\nc")
    assert carried.text_out == "[医生]：a\n[患者]：b\n[医生]：c"
    guessed = label(spark, "5x 6岁", "早\n嗯\n\n关键词\n好\n")
    assert guessed.text_out == "[医生]：早\n[患者家属]：嗯\n\n关键词\n[医生]：好\n"
    again = label(spark, "5x 6岁", guessed.text_out)
    assert again.text_out == guessed.text_out and not again.changed
    assert label(spark, "5x", None).text_out is None and label(spark, "5x", "").text_out == ""


def test_masking(spark):
    rows = spark.createDataFrame([(1, "5 Dr. Brown", "Mr. Smith came.\r\nNo name\nMs Lee and Mr Poe"), (2, None, None), (3, "x", "")], "file_id long, stem string, text string")
    got = {r.file_id: r for r in masking.mask(rows).collect()}
    assert (got[1].stem_out, got[1].text_out) == ("5 [NAME]", "[NAME] came.\r\nNo name\n[NAME] and [NAME]")
    assert got[1].renamed and got[1].changed
    assert got[2].text_out is None and not got[2].changed and got[3].text_out == ""
    counts = masking.mask_counts(masking.mask(rows)).first()
    assert (counts.files_output, counts.files_renamed, counts.files_changed) == (3, 1, 1)


def test_overlapping_and_invalid_spans(spark):
    spans = [(0, 3, "PER"), (2, 5, "ORG"), (5, 6, "ORG"), (7, 99, "PER"), (6, 6, "PER"), (6, 7, "DATE")]
    df = spark.createDataFrame([("abcdefgh", spans)], f"t string, s {masking.SPANS}")
    assert df.select(masking.replace_spans(df.t, df.s).alias("x")).first().x == "[NAME][ORG]gh"


class Client:
    """Answers by what the photo holds; counts its calls within a task."""

    def __init__(self):
        self.calls = 0

    def __call__(self, request):
        import base64

        self.calls += 1
        kind = base64.b64decode(request["file"]).decode()
        page = json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": "一"}}, {"markdown": {"text": "二"}}]}})
        if kind == "raise":
            raise OSError("no answer")
        if kind == "flaky":
            return (200, page) if self.calls % 3 == 0 else (500, "")
        return {"good": (200, page), "none": (200, '{"result": {"layoutParsingResults": []}}'), "gone": (404, "")}[kind]


def test_ocr(spark, tmp_path, monkeypatch):
    for kind, name in (("good", "a.JPG"), ("none", "b.png"), ("gone", "c.bmp"), ("raise", "d.jpeg"), ("flaky", "e.jpg"), ("good", "done.jpg"), ("good", "f.gif")):
        (tmp_path / name).write_bytes(kind.encode())
    monkeypatch.setattr(ocr, "shrink", lambda content: content)
    images = files.images(spark, str(tmp_path))
    done = spark.createDataFrame([("done",)], "stem string")
    todo = ocr.pending(images, done).repartition(5, "stem").cache()
    called = ocr.call(todo, Client(), pause=0, pacing=0)
    assert called.count() == 5
    # one photo in a table of its own, as a client counts its calls
    tries = {r.stem: ocr.call(todo.where(todo.stem == r.stem), Client(), pause=0, pacing=0).first() for r in todo.select("stem").collect()}
    assert {k: (v.status_code, v.tries) for k, v in tries.items()} == {"a": (200, 1), "b": (200, 1), "c": (404, 1), "d": (None, 3), "e": (200, 3)}
    rows = spark.createDataFrame(list(tries.values()), called.schema)
    results = {r.stem: (r.text, r.status) for r in ocr.results(rows).collect()}
    assert results["a"] == ("一\n二", "success") and results["b"][1] == results["c"][1] == results["d"][1] == "failed"
    assert ocr.counts(images, done, rows).first().asDict() == {"success": 2, "failed": 3, "skipped": 1}


def test_failed_files_are_no_patients(spark, folder, tmp_path):
    patients = build_folder(spark, folder)
    base = stats.summary(patients).first()
    assert base.base.patient_count == 2 and base.demographics.gender_distribution == {"男": 1, "女": 1}
    counts = {r.split: r for r in dataset.split_counts(dataset.split(patients), 4, 2).collect()}
    assert (counts["with_caregiver"].total_patients, counts["without_caregiver"].total_patients) == (1, 1)
    sinks.split_documents(patients, f"{tmp_path}/split", "here")
    text = "\n".join(r.value for r in spark.read.option("wholetext", "true").text(f"{tmp_path}/split/with_caregiver").collect())
    found = json.loads(text)
    assert found["stats"] == {"total_patients": 1, "total_visits": 2, "source_total_files": 4, "source_converted_files": 2}
    assert found["patients"][0]["visits"][0]["dialogue"]["source_file"] == "9 [NAME] 男 34岁.txt"
    sinks.one_document(dataset.document(patients, "here"), f"{tmp_path}/whole")
    sinks.summary_document(stats.summary(patients), f"{tmp_path}/summary", files.meta_of(files.dataset(spark, f"{tmp_path}/whole")))
    summary = json.loads("\n".join(r.value for r in spark.read.option("wholetext", "true").text(f"{tmp_path}/summary").collect()))
    assert summary["dataset_meta"]["source_total_files"] == 4 and len(summary["metric_definitions"]) == 33
    assert [r.patient_id for r in dataset.in_order(dataset.converted(patients)).collect()] == ["P-000009", "P-000012"]


def test_items_never_end_a_job(spark, folder):
    answers = sheet_rows(spark, [("9", "2.9999999", *"111111", *"222222222"), ("12", "1e30", *"000000", *"000000001")])
    rows = by_first_id(build(files.text_files(spark, folder), answers))
    assert rows[9].scales[0]["GAD-7"]["items"][0] == 2 and rows[12].error == "bad_item"
    assert by_first_id(build(files.text_files(spark, folder), answers.drop("序号")))[9].error == "no_id_column"


def test_command_line(spark, folder, tmp_path, capsys):
    main(["build", folder, "--out", f"{tmp_path}/d"])
    main(["split", f"{tmp_path}/d"])
    main(["stats", f"{tmp_path}/d", "--out", f"{tmp_path}/s"])
    main(["audit", folder])
    main(["label", folder, "--out", f"{tmp_path}/l"])
    main(["mask", folder])
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert said[0]["converted_files"] == 2 and said[1]["source_total_files"] == 4
    assert said[-2]["files_total"] == 4 and said[-1]["files_output"] == 4
    reports = {}
    for x in said:
        reports.setdefault(x.get("report"), []).append(x)
    assert reports["folder"][0]["file_count"] == 4 and [x["name"] for x in reports["no_id"]] == ["[NAME].txt"]
    assert [(x["id"], len(x["names"])) for x in reports["index"]] == [(7, 1), (9, 1), (12, 1), (13, 1)] and reports["all"][0]["unique_ids"] == 4 and "duplicate" not in reports
    assert [(x["first"], x["last"]) for x in reports["missing"]] == [(1, 6), (8, 8), (10, 11), (14, 133)]
    assert sorted(x for x in os.listdir(f"{tmp_path}/l") if x.endswith(".txt")) == sorted(x for x in os.listdir(folder) if x.endswith(".txt"))


def detector(text):
    return [(m.start(), m.end(), "PER") for m in re.finditer("Zoe", text)]


def test_texts_keep_their_places(spark, tmp_path, capsys):
    for name, text in (("a/x/1[N].txt", "Zoe\n"), ("b/x/1[N].txt", "a Zoe"), ("a/x/2[N].txt", "no"), ("a/3 Zoe.txt", "\n"), ("a/3 [NAME].txt", "y")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    roots, mask = [f"{tmp_path}/in/a", f"{tmp_path}/in/b"], ["--detector", "tests.test_files:detector", "--chunk-chars", "4", "--overlap", "3"]
    assert main(["label", *roots, "--out", f"{tmp_path}/l"]) == 0
    assert {p.relative_to(tmp_path / "l").as_posix(): p.read_bytes() for p in (tmp_path / "l").rglob("*.txt")} == {"a/x/1[N].txt": "[医生]：Zoe\n".encode(), "b/x/1[N].txt": "[医生]：a Zoe".encode(), "a/x/2[N].txt": "[医生]：no".encode(), "a/3 Zoe.txt": b"\n", "a/3 [NAME].txt": "[医生]：y".encode()}
    capsys.readouterr()
    assert main(["mask", *roots, *mask, "--dry-run", "--out", f"{tmp_path}/m"]) == 0
    said = capsys.readouterr().out.splitlines()
    assert len(said) == 6 and said[0].endswith("a/3 Zoe.txt -> a/3 [NAME].txt") and said[1].endswith("a/3 [NAME].txt -> a/3 [NAME].txt") and not (tmp_path / "m").exists()
    assert main(["mask", *roots, *mask, "--out", f"{tmp_path}/m"]) == 1  # two files would have one place
    got = capsys.readouterr()
    assert json.loads(got.err.splitlines()[0]) == {"rel_path": "a/3 [NAME].txt", "n": 2, "error": "collision"}
    assert json.loads(got.out.splitlines()[-1]) == {"files_output": 5, "files_renamed": 1, "files_changed": 2}
    assert {p.relative_to(tmp_path / "m").as_posix(): p.read_text() for p in (tmp_path / "m").rglob("*.txt")} == {"a/x/1[N].txt": "[NAME]\n", "b/x/1[N].txt": "a [NAME]", "a/x/2[N].txt": "no"}


def client(request):
    import base64

    text = base64.b64decode(request["file"]).decode()
    return 200, json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": text}}] if text != "none" else []}})


def test_photos_to_pages(spark, tmp_path, capsys):
    (tmp_path / "p").mkdir()
    for name, text in (("a.JPG", "一"), ("b.png", "none"), ("c.bmp", "三\n")):
        (tmp_path / "p" / name).write_text(text, encoding="utf-8")
    args = ["ocr", f"{tmp_path}/p", "--client", "tests.test_files:client", "--pacing", "0", "--out", f"{tmp_path}/md"]
    pages = lambda: {p.name: p.read_text(encoding="utf-8") for p in (tmp_path / "md").glob("*.md")}
    assert main(args) == 0 and pages() == {"a.md": "一", "c.md": "三\n"}
    (tmp_path / "p" / "d.jpeg").write_text("四", encoding="utf-8")
    (tmp_path / "p" / "b.png").write_text("二", encoding="utf-8")
    assert main(args) == 0 and pages() == {"a.md": "一", "b.md": "二", "c.md": "三\n", "d.md": "四"}
    said = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert said == [{"total": 3, "success": 2, "skipped": 0, "failed": 1}, {"total": 4, "success": 2, "skipped": 2, "failed": 0}]


def test_gaps_as_ranges(spark):
    of = lambda ids, *r: [(x["first"], x["last"]) for x in audit.missing_ranges(spark.createDataFrame([(i,) for i in ids], "id long"), *r).orderBy("first").collect()]
    assert of([]) == [(1, 133)] and of(range(1, 134)) == [] and of([None, 5, 5, 900, -3]) == [(1, 4), (6, 133)]
    far = [10**12 * i + i % 3 for i in range(1, 300)]
    ends = [0, *far, 10**15 + 1]
    assert of(far, 1, 10**15) == [(a + 1, b - 1) for a, b in zip(ends, ends[1:])]
    assert of(list(range(10**12, 10**12 + 5000)), 10**12 - 2, 10**12 + 5001) == [(10**12 - 2, 10**12 - 1), (10**12 + 5000, 10**12 + 5001)]
    assert [r.id for r in audit.missing_ids(spark.createDataFrame([(2,), (4,)], "id int"), 1, 5).orderBy("id").collect()] == [1, 3, 5]


def test_flat_scan(spark, folder, tmp_path):
    (tmp_path / "deeper").mkdir()
    (tmp_path / "1x.txt").write_text("a", encoding="utf-8")
    (tmp_path / "deeper" / "2x.txt").write_text("b", encoding="utf-8")
    assert [r.stem for r in files.text_files(spark, str(tmp_path), recursive=False).collect()] == ["1x"]
    assert files.text_files(spark, str(tmp_path)).count() == 2
