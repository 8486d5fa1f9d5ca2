"""A small invented corpus that holds every case of a dialogue file, with the whole nested result."""

import json

import pytest

from dialoom.operators import dataset, ocr, stats
from dialoom.plans.build import build_folder
from dialoom.sources import files, sinks

D, P, C, O = "doctor", "patient", "caregiver", "other"
#: stem -> text, and what is to come of it: (first id, name, gender, age, keywords, visits of (role, text, note)).
CORPUS = {
    "1甲": ("OUT\n[医生]：一\nOUT\n出去\n（走了）\n[患者]：二\n(x)\n[医生]：三\n OUT \n", (1, "甲", None, None, None, [[(D, "一", None)], [(P, "二", None)], [(D, "三", None)]])),
    "2 乙 女": ("[医生]：好OUT\n[患者]：嗯\nOUT[医生]：再\naOUTbOUTc", (2, "乙", "女", None, None, [[(D, "好", None)], [(P, "嗯", None)], [(D, "再a", None)], []])),
    "3丙 男 34岁": ("日期\n[患者家属]：早\n[医生]：问\n[患者]：答", (3, "丙", "男", 34, None, [[(D, "问", None), (P, "答", None)]])),
    "3 丙 男 34岁": ("前言[医生]：问", (3, "丙", "男", 34, None, [[(D, "问", None)]])),
    "4丁": ("只有\n[患者]：自己", (4, "丁", None, None, None, [[(P, "自己", None)]])),
    "5戊": ("[医生]：问\nOUT\n没有标记", (5, "戊", None, None, None, [[(D, "问", None)], []])),
    "6己 男 7": ("[医生]始\n[D1]一\n【P2（妈妈）】：二\n[患者家属]三\n[护士]：四\n[医生】五\n【家长（）】六", (6, "己", "男", 7, None, [[(D, "始", None), (D, "一", None), (P, "二", "妈妈"), (C, "三", None), (O, "四", None), (D, "五", None), (C, "六", None)]])),
    "7庚": ("[医生]：\n[患者]：\n续\n[医生]：\n\n", (7, "庚", None, None, None, [[(P, "续", None)]])),
    "8辛": ("[医生]：问\n[NAME]你好\n 后 \n续", (8, "辛", None, None, None, [[(D, "问", None), (O, "你好后续", None)]])),
    "9壬": ("关键词：甲、乙\n\n文字记录：\n[医生]：问", (9, "壬", None, None, None, [[(D, "问", None)]])),
    "10癸": ("关键词：\n甲，、 乙 、\n丙\n场景：诊室\n[医生]：问", (10, "癸", None, None, ["甲", "乙", "\n丙"], [[(D, "问", None)]])),
    "１１，12子": ("关键词:\n甲、\n\n文字记录:\n　[医生]：一\r\n　续  再\r\n　OUT　\r\n[患者]：二", (11, "子", None, None, ["甲"], [[(D, "一续再", None)], [(P, "二", None)]])),
    "13[NAME]": ("关键词:\n没有结尾\n[医生]：问", (13, "[NAME]", None, None, None, [[(D, "问", None)]])),
    "123": ("[医生]：问", (12, "3", None, None, None, [[(D, "问", None)]])),
    "14丑": ("", (14, "丑", None, None, None, [])),
}
FAILING = {"寅": (b"x", "bad_title"), "15卯": (b"\xff\xfe", "bad_utf8"), " 16": (b"x", "bad_title")}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    for stem, (text, _) in CORPUS.items():
        (top / f"{stem}.txt").write_bytes(text.encode())
    for stem, (content, _) in FAILING.items():
        (top / f"{stem}.txt").write_bytes(content)
    out = f"{top}/built"
    sinks.tables(build_folder(spark, str(top)), out)
    return spark.read.parquet(out)


def test_every_file(built):
    got = {}
    for r in built.where("error IS NULL").collect():
        visits = [[(t.role, t.text, t.speaker_note) for t in v.dialogue.turns] for v in r.visits]
        got[r.path.rsplit("/", 1)[-1].removesuffix(".txt")] = (r.ids[0], r.name, r.gender, r.age, r.keywords, visits)
        assert r.patient_id == f"P-{r.ids[0]:06}" and [v.visit_id for v in r.visits] == [f"V-{r.ids[0]:06}-{i}" for i in range(1, len(r.visits) + 1)]
    assert got == {stem: want for stem, (_, want) in CORPUS.items()}
    failed = {r.path.rsplit("/", 1)[-1].removesuffix(".txt"): r.error for r in built.where("error IS NOT NULL").collect()}
    assert failed == {stem: error for stem, (_, error) in FAILING.items()}


def test_order_counts_split_and_summary(spark, built, tmp_path):
    order = [r.patient_id for r in dataset.in_order(dataset.converted(built)).collect()]
    assert order == sorted(order) and len(order) == len(CORPUS) and order.count("P-000003") == 2
    counts = dataset.build_figures(built).first()
    visits = [want[5] for _, want in CORPUS.values()]
    assert (counts.total_files, counts.converted_files, counts.failed_files) == (len(CORPUS) + 3, len(CORPUS), 3)
    assert (counts.patients_with_keywords, counts.patients_with_gender, counts.patients_with_age, counts.total_visits) == (2, 4, 3, sum(map(len, visits)))
    split = {r.split: r.total_patients for r in dataset.split_counts(dataset.split(built)).collect()}
    assert split == {"with_caregiver": 1, "without_caregiver": len(CORPUS) - 1}
    s = stats.summary(built).first()
    assert s.visits_and_dialogue.visits_per_patient["min"] == 0 and s.visits_and_dialogue.turns_per_visit["min"] == 0
    roles = [t[0] for v in visits for turns in v for t in turns]
    assert s.visits_and_dialogue.turn_role_distribution == {r: roles.count(r) for r in (D, P, C, O)}
    figures = {r.metric: (r.value, r.counts) for r in stats.explained(stats.summary(built)).collect()}
    assert len(figures) == 33 and figures["base.patient_count"] == (len(CORPUS), None) and figures["demographics.gender_distribution"][1] == "unknown=11,女=1,男=3"
    sinks.ordered_document(built, f"{tmp_path}/d", "corpus")
    sinks.join_document(spark, f"{tmp_path}/d", f"{tmp_path}/whole.json")
    whole = json.loads((tmp_path / "whole.json").read_text(encoding="utf-8"))
    assert [p["patient_id"] for p in whole["patients"]] == order and [e["error"] for e in whole["stats"]["errors"]].count("bad_title") == 2
    good, bad = files.checked(spark, f"{tmp_path}/whole.json")
    assert bad.isEmpty() and sorted(r.patient_id for r in files.patients_of(good).collect()) == order


class Picture:
    """What Pillow does to a photo, written down."""

    calls: list = []

    def convert(self, mode):
        self.calls.append(("convert", mode))
        return self

    def thumbnail(self, size, how):
        self.calls.append(("thumbnail", size, how))

    def save(self, out, kind, quality):
        self.calls.append(("save", kind, quality))
        out.write(b"jpeg")


def test_photos_are_shrunk_where_pillow_is(monkeypatch):
    import sys
    import types

    image = types.SimpleNamespace(open=lambda stream: Picture(), Resampling=types.SimpleNamespace(LANCZOS="lanczos"))
    monkeypatch.setitem(sys.modules, "PIL", types.SimpleNamespace(Image=image))
    monkeypatch.setitem(sys.modules, "PIL.Image", image)
    assert ocr.shrink(b"png") == b"jpeg"
    assert Picture.calls == [("convert", "RGB"), ("thumbnail", (2000, 2000), "lanczos"), ("save", "JPEG", 85)]
    monkeypatch.setitem(sys.modules, "PIL", None)
    with pytest.warns(UserWarning, match="Pillow"):
        assert ocr.shrink(b"png") == b"png"
