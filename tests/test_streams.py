"""Audit, summary and photos that go on from batch to batch, after restarts too."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from dialoom.operators import audit, ocr, stats
from dialoom.plans.build import build_folder
from dialoom.sources import files
from dialoom.streaming import audits, ingest, photos

BATCHES = [["7x.txt", "9，12x.txt", "no id.txt"], ["7y.txt", "12 z.txt", "9，9 w.txt"], ["133x.txt", "none.txt", "7，7，7q.txt", "sub/7x.txt"]]
TEXT = "关键词:\n甲、\n\n文字记录:\n[医生]：问\n[患者家属]：答\nOUT\n[医生]：再"


def put(top, names):
    for name in names:
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(TEXT, encoding="utf-8")


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_three_audits_give_what_one_gives(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    source.mkdir()
    for n, names in enumerate(BATCHES, 1):
        put(source, names)
        audits.follow(spark, str(source), out, checkpoint).awaitTermination()  # each time a new query, as after a restart
        seen = audits.sightings(spark, out)
        named = audit.named_ids(files.text_files(spark, str(source), in_order=False).withColumn("folder", F.col("folder")))
        assert named.count() == sum(map(len, BATCHES[:n]))
        for mine, whole in ((audits.folder_counts, audit.folder_counts), (audits.duplicates, audit.duplicates), (audits.index, audit.index), (audits.without_ids, audit.without_ids)):
            assert plain(mine(seen)) == plain(whole(named)), mine.__name__
        assert plain(audits.missing_ranges(seen)) == plain(audit.missing_ranges(audit.all_ids(named)))
        assert {r.id for r in audits.first_sightings(seen).collect()} == {r.id for r in audit.all_ids(named).collect()}
    audits.follow(spark, str(source), out, checkpoint).awaitTermination()  # nothing new
    assert audits.sightings(spark, out).count() == seen.count()


def test_a_batch_that_failed_is_counted_once(spark, tmp_path, monkeypatch):
    source, out, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    put(source, BATCHES[0])
    audits.follow(spark, str(source), out, checkpoint).awaitTermination()
    put(source, BATCHES[1])
    monkeypatch.setattr(audits, "prefix_ids", lambda stem: F.array(F.raise_error(F.lit("stop")).cast("int")))
    with pytest.raises(Exception, match="stop"):
        audits.follow(spark, str(source), out, checkpoint).awaitTermination()
    monkeypatch.undo()
    audits.follow(spark, str(source), out, checkpoint).awaitTermination()
    named = audit.named_ids(files.text_files(spark, str(source), in_order=False))
    assert plain(audits.folder_counts(audits.sightings(spark, out))) == plain(audit.folder_counts(named))


def test_three_summaries_give_what_one_gives(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for names in BATCHES[:2]:
        put(source, names)
        ingest.ingest(spark, str(source), f"{tmp_path}/out", f"{tmp_path}/checkpoint", tallies=f"{tmp_path}/tallies").awaitTermination()
    got = ingest.summary_so_far(spark, f"{tmp_path}/tallies").first()
    assert got == stats.summary(build_folder(spark, str(source))).first() and got.base.patient_count == 5
    assert got.visits_and_dialogue.turns_per_visit.asDict() == {"count": 10, "mean": 1.5, "median": 1.5, "min": 1, "max": 2}


class Service:
    """Writes down each photo it is sent; answers by what the photo holds."""

    def __init__(self, log, down=False):
        self.log, self.down = log, down

    def __call__(self, request):
        kind = base64.b64decode(request["file"]).decode()
        with open(self.log, "a", encoding="utf-8") as f:
            f.write(f"{kind}\n")
        if self.down or kind.startswith("busy"):
            return 500, ""
        if kind.startswith("gone"):
            return 404, ""
        return 200, json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": "" if kind.startswith("empty") else kind}}]}})


def test_photos_with_a_ledger(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ocr, "shrink", lambda content: content)
    source, out, log = tmp_path / "in", f"{tmp_path}/out", tmp_path / "log"
    source.mkdir()
    follow = lambda down=False: photos.follow(spark, str(source), out, f"{tmp_path}/checkpoint", Service(str(log), down), pacing=0, wait=0.0, prepare=bytes).awaitTermination()
    sent = lambda: sorted(log.read_text(encoding="utf-8").split())
    for name in ("good1.jpg", "busy1.png", "gone1.BMP", "empty1.jpeg", "notes.txt"):
        (source / name).write_text(name.split(".")[0], encoding="utf-8")
    follow()
    assert sent() == ["busy1", "empty1", "gone1", "good1"]
    assert photos.counts(photos.ledger(spark, out)).first().asDict() == {"success": 1, "failed": 2, "retry": 1, "attempts": 4}
    (source / "good2.jpg").write_text("good2", encoding="utf-8")
    (source / "good1.png").write_text("again", encoding="utf-8")  # a stem that has a page is skipped
    follow()
    assert sent() == ["busy1", "busy1", "empty1", "gone1", "good1", "good2"]
    follow()  # nothing has arrived
    service = Service(str(log))
    for _ in range(3):
        photos.take(spark, None, out, service, "retry-1", pacing=0, prepare=bytes)  # the same round three times
    photos.take(spark, None, out, service, "retry-2", pacing=0, prepare=bytes)
    assert sent() == ["busy1"] * 3 + ["empty1", "gone1", "good1", "good2"]  # three attempts, then it has failed for good
    assert {r.stem: (r.status, r.attempts, r.text) for r in photos.standing(photos.ledger(spark, out)).collect()} == {
        "good1": ("success", 1, "good1"), "good2": ("success", 1, "good2"), "busy1": ("failed", 3, None), "gone1": ("failed", 1, None), "empty1": ("failed", 1, None),
    }


def test_next_tries_wait(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("p", "s", b"x")], "path string, stem string, content binary")
    at = lambda second: F.lit(f"2030-01-01 00:{second // 60:02}:{second % 60:02}").cast("timestamp")
    same = lambda due: due.withColumn("content", F.lit(b"x"))
    log = tmp_path / "log"
    for name, second, want in (("a", 0, 1), ("b", 59, 1), ("c", 60, 2), ("d", 179, 2), ("e", 180, 3), ("f", 9999 % 3600, 3)):
        photos.take(spark, rows, f"{tmp_path}/out", Service(str(log), down=True), name, at(second), same, pacing=0, wait=60.0, prepare=bytes)
        assert len(log.read_text().split()) == want, name
    assert photos.counts(photos.ledger(spark, f"{tmp_path}/out")).first().failed == 1
