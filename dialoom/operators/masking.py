"""Masking of names and organisations with a detector that can be replaced."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import AFTER_LINE

#: (start, end, label) in code points. A detector gives those of a text, or of each of many.
Span = tuple[int, int, str]
Detector = Callable[[str], list[Span]]
BatchDetector = Callable[[list[str]], list[list[Span]]]
_AFTER_LINE = re.compile(AFTER_LINE)
SPANS = "array<struct<start:int,end:int,label:string>>"
#: The placeholders; fixed values.
PLACEHOLDERS = {"NAME": "[NAME]", "ORG": "[ORG]"}
_DEFAULT = ((re.compile(r"(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]+"), "PER"), (re.compile(r"[一-鿿]{2,8}(?:医院|公司|大学)"), "ORG"))


#: Bytes of texts that go to a worker at once, about, and that are taken apart into lines and slices at once.
BATCH_BYTES, RUN_BYTES = 4 << 20, 1 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Sends texts to Python workers in batches of bounded bytes, where Spark would send 10,000 rows however long. A session's own smaller bound stays."""
    if not 0 < _bytes_of(spark.conf.get(_BATCH_KEY)) <= BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)


def _bytes_of(size: str) -> int:
    """A size as a session gives it: a number, or one with a unit."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)i?b?", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def pattern_detector(text: str) -> list[tuple[int, int, str]]:
    """The detector for where no model is at hand: titles with a name, and institutions."""
    return [(*m.span(), label) for pattern, label in _DEFAULT for m in pattern.finditer(text)]


def chunks(text: Column, size: int = 400) -> Column:
    """array<struct<start, chunk>>: slices of a text with their places from 0. None for null and empty texts."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("chunk")))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<struct<start:int,chunk:string>>"))


def entity_kind(label: Column) -> Column:
    """NAME for labels of persons, ORG for organisations, else null."""
    up = F.upper(label)
    return F.when(up.rlike("PER|NAME"), "NAME").when(up.contains("ORG"), "ORG")


def kind_of(label: str | None) -> str | None:
    """entity_kind of one label."""
    up = (label or "").upper()
    return "NAME" if "PER" in up or "NAME" in up else "ORG" if "ORG" in up else None


def resolved(spans: list[Span], length: int) -> list[Span]:
    """Spans of known kinds with valid places, in order, under their kinds; overlapping ones are merged under the first's."""
    out: list[Span] = []
    for start, end, kind in sorted((s, e, kind_of(label)) for s, e, label in spans if kind_of(label)):
        if 0 <= start < end <= length:
            if out and start < out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2])
            else:
                out.append((start, end, kind))
    return out


def replaced(text: str, spans: list[Span]) -> str:
    """A text with each span's placeholder instead of it: what lies between the spans is cut out once and joined."""
    out, at = [], 0
    for start, end, kind in resolved(spans, len(text)):
        out += text[at:start], PLACEHOLDERS[kind]
        at = end
    return "".join([*out, text[at:]])


def replace_spans(text: Column, spans: Column) -> Column:
    """A text column with each of its spans (SPANS) replaced; a null text stays null, null spans are none.

    In Python, as merging in SQL's own functions would copy what is merged so far for each span.
    """

    def of(texts: pa.Array, found: pa.Array) -> pa.Array:
        one = lambda t, f: None if t is None else replaced(t, [(s["start"], s["end"], s["label"]) for s in f or ()])
        return pa.array([one(t.as_py(), f.as_py()) for t, f in zip(texts, found)], pa.string())

    bound_batches(SparkSession.active())
    return F.arrow_udf(of, "string")(text, spans)


#: Detectors that have been made in this worker.
_MADE: dict[str, BatchDetector] = {}


class Loaded:
    """A detector that is made where it runs, once for each worker, as a model is: make() gives a function of many slices at once, list[str] -> list of their spans."""

    def __init__(self, make: Callable[[], BatchDetector]) -> None:
        self.make = make
        self.key = hashlib.sha256(cloudpickle.dumps(make)).hexdigest()

    def __call__(self, slices: list[str]) -> list[list[Span]]:
        if self.key not in _MADE:
            _MADE[self.key] = self.make()
        return _MADE[self.key](slices)


def windows(length: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the slices of a text, which share overlap characters."""
    if length <= size:
        return [(0, length)]
    overlap = min(overlap, size - 1)
    return [(at, min(at + size, length)) for at in range(0, length - overlap, size - overlap)]


def stitched(spans: Iterable[Span]) -> list[Span]:
    """Spans that slices found, in order: those of one label that overlap are one, as each slice saw a part of it or all."""
    out, last = [], {}
    for start, end, label in sorted(spans):
        if label in last and start < out[last[label]][1]:
            out[last[label]] = (out[last[label]][0], max(end, out[last[label]][1]), label)
        else:
            last[label] = len(out)
            out.append((start, end, label))
    return out


def spans_of(texts: list[str | None], detector: Detector | Loaded, size: int = 400, overlap: int = 100, together: int = 64) -> list[list[Span]]:
    """The spans in each text, from slices of at most size characters, those of many texts at once.

    Slices overlap, and what they find is stitched by the union of intervals, so that nothing that any slice finds is
    lost at a cut. A span that reaches a slice's cut end is looked for again in a slice twice as long, and so on: an
    entity is found whole wherever it stands, however long, if the detector needs
    no more than overlap to see it begin and takes it alike wherever it starts to read.
    """
    batch = detector if isinstance(detector, Loaded) else lambda slices: [detector(x) for x in slices]
    found: dict[int, set[Span]] = {}  # of texts that have any, as most lines have none
    todo = ((n, *w) for n, text in enumerate(texts) if text for w in windows(len(text), size, overlap))
    while todo:
        longer = []
        for some in batched(todo, together):
            for (n, start, end), spans in zip(some, batch([texts[n][start:end] for n, start, end in some])):
                own = [(start + s, start + e, label) for s, e, label in spans]
                if own:
                    found.setdefault(n, set()).update(own)
                if end < len(texts[n]) and (cut := [s for s, e, _ in own if e >= end]):
                    longer.append((n, max(start, min(cut) - overlap), min(2 * end - start, len(texts[n]))))
        todo = longer
    return [stitched(found.get(n, ())) for n in range(len(texts))]


_SPAN_KIND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))


def detect(text: Column, detector: Detector | Loaded = pattern_detector, size: int = 400, overlap: int = 100) -> Column:
    """The spans that a detector finds in a text column, as spans_of does. None for null texts."""

    def some(texts: list[str | None]) -> list[list[dict]]:
        return [[dict(zip(("start", "end", "label"), x)) for x in spans] for spans in spans_of(texts, detector, size, overlap)]

    def of(texts: pa.Array) -> pa.Array:
        return _in_runs(texts, some, _SPAN_KIND)

    bound_batches(SparkSession.active())
    return F.arrow_udf(of, SPANS)(text)


def masked_lines(texts: list[str | None], detector: Detector | Loaded, size: int, overlap: int) -> list[str | None]:
    """The texts with each line masked for itself, every line's end as it was."""
    lines = [_AFTER_LINE.split(t) if t else [] for t in texts]
    flat = [x for some in lines for x in some]
    done = iter([replaced(x, spans) for x, spans in zip(flat, spans_of([x if x.strip() else None for x in flat], detector, size, overlap))])
    return [t if not t else "".join(next(done) for _ in some) for t, some in zip(texts, lines)]


def masked(text: Column, detector: Detector | Loaded = pattern_detector, size: int = 400, overlap: int = 100) -> Column:
    """A text column with each line's entities replaced; null stays null."""

    def of(texts: pa.Array) -> pa.Array:
        return _in_runs(texts, lambda some: masked_lines(some, detector, size, overlap), pa.string())

    bound_batches(SparkSession.active())
    return F.arrow_udf(of, "string")(text)


def _in_runs(texts: pa.Array, act: Callable[[list[str | None]], list], kind: pa.DataType) -> pa.Array:
    """What act makes of texts, of no more at once than needed."""
    out, at = [], 0
    for end in _cuts(pc.binary_length(texts).fill_null(0).to_pylist()):
        out.append(pa.array(act(texts.slice(at, end - at).to_pylist()), kind))
        at = end
    return pa.concat_arrays(out) if out else pa.array([], kind)


def _cuts(sizes: list[int], most: int = RUN_BYTES) -> Iterator[int]:
    """Ends of runs of texts of about most bytes."""
    held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield i
            held = 0
        held += n
    if sizes:
        yield len(sizes)


def mask(files: DataFrame, detector: Detector | Loaded = pattern_detector, size: int = 400, key: str = "file_id", overlap: int = 100) -> DataFrame:
    """key, stem_out, text_out, renamed, changed of files with key, stem and text, each on its own row: nothing is shuffled.

    Each line is masked for itself, and every line's end is kept as it was. Null texts and stems stay null; keys may
    be null or repeat.
    """
    bound_batches(files.sparkSession)
    out = files.select(F.col(key).alias("k"), "stem", "text", masked(F.col("stem"), detector, size, overlap).alias("stem_out"), masked(F.col("text"), detector, size, overlap).alias("text_out"))
    return out.select(F.col("k").alias(key), "stem_out", "text_out", (~F.col("stem_out").eqNullSafe(F.col("stem"))).alias("renamed"), (~F.col("text_out").eqNullSafe(F.col("text"))).alias("changed"))


def mask_counts(masked: DataFrame) -> DataFrame:
    """One row: files put out, renamed and changed."""
    return masked.agg(F.count("*").alias("files_output"), F.count_if("renamed").alias("files_renamed"), F.count_if("changed").alias("files_changed"))
