"""python -m dialoom COMMAND: build, split, stats, audit, label, mask or ocr over folders, with the counters on standard output."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import audit, dataset, masking, ocr, speakers, stats
from .plans.build import build_folder
from .sources import files, sinks, trees


def _report(df: DataFrame) -> None:
    """The first row of a report, which is one row."""
    print(json.dumps(df.first().asDict(recursive=True), ensure_ascii=False, default=str))


def _at(name: str):  # noqa: ANN202
    """What module:attribute names."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _written(texts: DataFrame, out: str, mode: str = "errorifexists") -> int:
    """Writes rel_path and text; what has no place of its own is reported. The exit code."""
    try:
        sinks.write_mirrored(texts, out, mode)
    except sinks.Collisions as left_out:
        for row in left_out.rows.toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False), file=sys.stderr)
        print(left_out, file=sys.stderr)
        return 1
    return 0


def _texts(args: argparse.Namespace, spark: SparkSession) -> int:
    """label and mask: every file's new text at its own path, within the folder that all folders are in."""
    source = files.text_files(spark, args.folders)
    stem = "stem"
    if args.command == "label":
        done = speakers.label(source)
    else:
        stem = "stem_out"
        detector = _at(args.detector) if args.detector else masking.pattern_detector
        done = masking.mask(source, detector, args.chunk_chars, overlap=args.overlap)
    folder = files.within(F.concat("folder", F.lit("/")), args.folders)
    placed = done.join(source.select("file_id", "path", "folder", *(["stem"] if stem == "stem" else [])), "file_id")
    texts = placed.select("path", F.concat(folder, F.col(stem), F.lit(".txt")).alias("rel_path"), F.col("text_out").alias("text"))
    failed = 0
    if args.dry_run:
        for row in texts.select("path", "rel_path").orderBy("path").toLocalIterator():
            print(f"{row.path} -> {row.rel_path}")
    elif args.out:
        failed = _written(texts.select("rel_path", "text"), args.out)
    _report(speakers.label_counts(done) if args.command == "label" else masking.mask_counts(done))
    return failed


def _audit(args: argparse.Namespace, spark: SparkSession) -> None:
    """Of each folder counts, names without ids, ids that repeat and the files of each id; then the ids of all and the gaps among them."""
    named = audit.named_ids(files.text_files(spark, args.folders, in_order=False))
    say = lambda kind, rows: [print(json.dumps({"report": kind} | r.asDict(), ensure_ascii=False)) for r in rows.toLocalIterator()]
    say("folder", audit.folder_counts(named).orderBy("folder"))
    say("no_id", audit.without_ids(named).orderBy("folder", "name"))
    say("duplicate", audit.duplicates(named).orderBy("folder", "id"))
    say("index", audit.index(named).orderBy("folder", "id"))
    say("all", audit.all_ids(named).agg(F.count("*").alias("unique_ids"), F.min("id").alias("first"), F.max("id").alias("last")))
    say("missing", audit.missing_ranges(audit.all_ids(named), args.first, args.last).orderBy("first"))


def _ocr(args: argparse.Namespace, spark: SparkSession) -> int:
    """Photos of a folder that have no page yet to a page each, named by the photo; failed ones are left for the next time."""
    if not args.client:
        raise SystemExit("ocr needs --client, as no service is built in")
    images = files.images(spark, args.folders[0])
    stem = F.regexp_extract("rel_path", r"([^/]*)\.md$", 1)
    there = args.out and files.existing(spark, [args.out])
    done = trees.read(spark, args.out, "*.md", recursive=False).select(stem.alias("stem")) if there else spark.createDataFrame([], "stem string")
    todo = ocr.pending(images, done).count()
    skipped = images.count() - todo
    results = ocr.results(ocr.call(ocr.pending(images, done), _at(args.client), pacing=args.pacing))
    if not args.out:
        results.show(truncate=60)
        return 0
    # a photo is sent once: what came of it is written before it is counted
    ledger = f"{args.out.rstrip('/')}/{trees.COLLISIONS}-results"
    results.write.mode("overwrite").parquet(ledger)
    known = spark.read.schema(results.schema).parquet(ledger)
    good = known.where(F.col("status") == "success")
    failed = _written(good.select(F.concat("stem", F.lit(".md")).alias("rel_path"), "text"), args.out, "append")
    print(json.dumps({"total": todo + skipped, "success": good.count(), "skipped": skipped, "failed": known.where(F.col("status") == "failed").count()}))
    return failed


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="dialoom", description=__doc__)
    parser.add_argument("command", choices=("build", "split", "stats", "audit", "label", "mask", "ocr"))
    parser.add_argument("folders", nargs="+", help="folders of *.txt; for split and stats, a dataset document; for ocr, a folder of photos")
    parser.add_argument("--sheet", help="score sheet: csv, parquet or xlsx (build)")
    parser.add_argument("--out", help="where to write; a report alone without it")
    parser.add_argument("--detector", help="module:attribute of a detector, or of a masking.Loaded (mask)")
    parser.add_argument("--chunk-chars", type=int, default=400, help="the most characters that the detector gets at once (mask)")
    parser.add_argument("--overlap", type=int, default=100, help="characters that neighbouring chunks share (mask)")
    parser.add_argument("--dry-run", action="store_true", help="say which path each file would get, and write nothing (label, mask)")
    parser.add_argument("--first", type=int, default=1, help="the first id that is expected (audit)")
    parser.add_argument("--last", type=int, default=133, help="the last id that is expected (audit)")
    parser.add_argument("--client", help="module:attribute of a client of an OCR service (ocr)")
    parser.add_argument("--pacing", type=float, default=0.5, help="seconds after each photo of a task (ocr)")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("dialoom").getOrCreate()
    failed = 0
    if args.command == "build":
        patients = build_folder(spark, args.folders, args.sheet)
        if args.out:
            sinks.one_document(dataset.document(patients, ",".join(args.folders)), args.out)
        _report(dataset.build_counts(patients))
    elif args.command in ("split", "stats"):
        document, faults = files.checked(spark, args.folders[0])
        for row in faults.toLocalIterator():
            failed = 1
            print(json.dumps(row.asDict(), ensure_ascii=False), file=sys.stderr)
        patients, meta = files.patients_of(document), files.meta_of(document)
        if args.command == "split":
            known = meta.first() or Row(source_total_files=0, source_converted_files=0)
            divided = dataset.split(patients)
            for row in dataset.split_counts(divided, known.source_total_files, known.source_converted_files).collect():
                print(json.dumps(row.asDict()))
            if args.out:
                sinks.split_tables(divided, args.out)
        else:
            figures = stats.summary(patients)
            if args.out:
                sinks.summary_document(figures, args.out, meta)
            _report(figures)
    elif args.command == "audit":
        _audit(args, spark)
    elif args.command == "ocr":
        return _ocr(args, spark)
    else:
        return _texts(args, spark)
    return failed


if __name__ == "__main__":
    sys.exit(main())
