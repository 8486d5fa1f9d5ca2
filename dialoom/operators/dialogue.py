"""From a dialogue's text to keywords, visits and turns.

All are expressions on one row: a text is small beside a table of them, and so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clinical
from ..functions.text import FIELD, MARK, after, bound, lines, strip, without_first

_KEYWORDS = r"(?sU)关键词[:：]?\s*\n(.+?)(?:\n\s*\n|\n(?:文字记录|场景)[:：])"
_LABEL = r"(?U)^(文字记录|场景)[:：]\s*"
#: The tag that the dialogue proper begins with.
DOCTOR_TAG = "[医生]"


def keyword_list(block: Column) -> Column:
    """The words of a keyword block, blank ones left out."""
    return F.transform(F.filter(F.split(block, "[、，]"), lambda w: strip(w) != ""), lambda w: F.btrim(w, F.lit(" ，、")))


def keywords(text: Column) -> Column:
    """The keyword block's words, null without a block or a word in it."""
    return bound(keyword_list(strip(F.regexp_extract(text, _KEYWORDS, 1))), lambda kept: F.when(F.size(kept) > 0, kept))


def body(text: Column) -> Column:
    """The text without its keyword block and the label before the dialogue."""

    def without_block(x: Column) -> Column:
        return F.when(x["block"] != "", without_first(x["text"], x["block"], "\n")).otherwise(x["text"])

    rest = bound(F.struct(text.alias("text"), F.regexp_extract(text, _KEYWORDS, 0).alias("block")), without_block)
    return F.regexp_replace(strip(rest), _LABEL, "")


def from_first_doctor(text: Column) -> Column:
    """The text from the first doctor's tag on, wherever it stands; all of it without one."""
    return strip(after(text, DOCTOR_TAG))


def visits(content: Column) -> Column:
    """The texts of a dialogue's visits, those that are blank left out.

    A line that is OUT or 出去 or stands in parentheses separates visits; a line with OUT in it is cut there once.
    """

    def cut(line: Column) -> Column:
        at = lambda s: F.instr(s, "OUT")
        around = lambda s: F.array(strip(F.substring(s, F.lit(1), at(s) - 1)), F.lit(MARK), strip(F.substring(s, at(s) + 3, F.length(s))))
        wrapped = lambda s: (s.startswith("（") & s.endswith("）")) | (s.startswith("(") & s.endswith(")"))
        mark = F.array(F.lit(MARK))
        special = lambda s: F.when(s.isin("OUT", "出去"), mark).when(at(s) > 0, F.filter(around(s), lambda x: x != "")).when(wrapped(s), mark)
        return F.coalesce(bound(strip(line), special), F.array(line))

    parts = F.split(F.array_join(F.flatten(F.transform(lines(content), cut)), "\n"), MARK)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def turns(visit: Column) -> Column:
    """array<struct<role, text, speaker_note>> of a visit's text.

    A marker opens a turn, and the lines after it are joined to it without a separator; what stands before the
    first marker is dropped, and so are turns without text.
    """

    def mark(line: Column) -> Column:
        opened = line.startswith("[") | line.startswith("【")  # which spares most lines the pattern
        parts = F.regexp_replace(line, clinical.MARKER, f"{MARK}$1{FIELD}$2")
        return F.when(opened, parts).otherwise(line)

    marked = F.transform(F.filter(F.transform(lines(visit), strip), lambda x: x != ""), mark)
    opened = bound(F.split(F.array_join(marked, ""), MARK), lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))

    def turn(part: Column) -> Column:
        fields = lambda f: F.struct(clinical.role_of(f[0]).alias("role"), strip(f[1]).alias("text"), clinical.speaker_note(f[0]).alias("speaker_note"))
        return bound(F.split(part, FIELD, 2), fields)

    return F.filter(F.transform(opened, turn), lambda t: t["text"] != "")


def parse(files: DataFrame) -> DataFrame:
    """Adds keywords and visits, array<struct<visit_no, turns>>, to files with a text. A null text has null visits."""
    content = files.withColumns({"keywords": keywords(F.col("text")), "visits": visits(from_first_doctor(body(F.col("text"))))})
    numbered = F.transform("visits", lambda v, i: F.struct((i + 1).alias("visit_no"), turns(v).alias("turns")))
    return content.withColumn("visits", numbered)


def turn_table(parsed: DataFrame, key: str = "file_id") -> DataFrame:
    """key, visit_no, turn_no, role, text, speaker_note: a row for each turn of what parse gives."""
    v = parsed.select(key, F.explode("visits").alias("v"))
    t = v.select(key, "v.visit_no", F.posexplode("v.turns").alias("i", "t"))
    return t.select(key, "visit_no", (F.col("i") + 1).alias("turn_no"), "t.role", "t.text", "t.speaker_note")
