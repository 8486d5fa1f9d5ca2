"""Speaker labels for transcripts: explicit markers where there are any, else alternating speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clinical
from ..functions.text import FIELD, MARK, bound, lines, strip

#: Labels, header words and cues; fixed values.
DOCTOR, PATIENT, FAMILY = "[医生]", "[患者]", "[患者家属]"
ROLE_LINES = ((r"(?U)^\s*医生\s*[：:]?\s*$", DOCTOR), (r"(?U)^\s*患者\s*[：:]?\s*$", PATIENT), (r"(?U)^\s*家属\d*\s*[：:]?\s*$", FAMILY))
HEADERS = ("关键词", "关键字", "文字记录", "文本记录", "对话记录")
FAMILY_LABELS = ("家长", "家属", "爸爸", "妈妈", "妻子", "丈夫", "父母")
FAMILY_CUES = ("我家孩子", "孩子", "我儿子", "我女儿", "我孙子", "我孙女", "他妈妈", "他爸爸", "家里")
_BRACKET = r"(?dU)^\s*【([^】]+)】\s*[：:]?\s*(.*)$"
_DATE = r"(?U)\d{4}年\s*\d{1,2}月\s*\d{1,2}日"
_OPENER = r"^(你好[，, ]*医生|医生[，, ：:]|请问医生|医生你好)"
_TAGGED = r"^\[(医生|患者|患者家属)\]："


def bracket_label(line: Column) -> Column:
    """A line with a lenticular D or P label in the square form; null for any other line."""

    def tag(raw: Column) -> Column:
        side = F.when(raw.rlike("|".join(FAMILY_LABELS)), FAMILY).when(raw.contains("患者"), PATIENT).when(raw.contains("孩子"), FAMILY).otherwise(PATIENT)
        return F.when(raw.startswith("D"), F.lit(DOCTOR)).when(raw.startswith("P"), side)

    label = bound(strip(F.regexp_extract(line, _BRACKET, 1)), tag)
    return F.when(line.contains("【") & line.rlike(_BRACKET), F.concat(label, F.lit("："), strip(F.regexp_extract(line, _BRACKET, 2))))


def role_line(line: Column) -> Column:
    """The label of a line that holds nothing but a role; null for any other line."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(ROLE_LINES):
        out = F.when(line.rlike(pattern), label).otherwise(out)
    return F.when(line.contains("医生") | line.contains("患者") | line.contains("家属"), out)  # which spares most lines the patterns


def is_meta(line: Column) -> Column:
    """Blank, a header, or a line with a date."""
    return bound(strip(line), _meta)


def _meta(s: Column) -> Column:
    header = F.lit(False)
    for word in HEADERS:
        header = header | s.startswith(word)
    return (s == "") | header | (s.contains("年") & s.rlike(_DATE))


def is_skipped(line: Column) -> Column:
    """A line that alternation leaves alone."""
    return bound(strip(line), lambda s: _meta(s) | s.endswith(":") | s.endswith("："))


def is_patient_opener(line: Column) -> Column:
    return strip(line).rlike(_OPENER)


def other_side(age: Column, line: Column) -> Column:
    """The label of whoever is not the doctor, from age and the first line."""
    family = strip(line).rlike("|".join(FAMILY_CUES)) | F.coalesce(age < 18, F.lit(False))
    return F.when(family, FAMILY).otherwise(PATIENT)


def _marked(line: Column) -> Column:
    """A role line as MARK and its label, a line with a label of its own as FIELD and the line in square form, any other as it is."""
    square = bound(bracket_label(line), lambda b: F.when(b.isNotNull(), F.concat(F.lit(FIELD), b)))
    role = bound(role_line(line), lambda r: F.when(r.isNotNull(), F.concat(F.lit(MARK), r)))
    tagged = F.when(line.startswith("[") & line.rlike(_TAGGED), F.concat(F.lit(FIELD), line))
    return F.coalesce(square, role, tagged, line)


def _parts(marked: Column) -> Column:
    """What stands before each MARK of an array of lines, and after the last."""
    return F.split(F.array_join(marked, "\n"), f"\n?{MARK}")


def explicit_lines(marked: Column) -> Column:
    """The lines of _marked with their labels: a role line holds for the lines after it and is itself left out."""

    def out(p: Column) -> Column:
        def one(x: Column) -> Column:
            carried = F.when((p[0] != "") & (strip(x) != ""), F.concat(p[0], F.lit("："), strip(x))).otherwise(x)
            return F.when(x.startswith(FIELD), F.substring(x, 2, 1 << 30)).otherwise(carried)

        return F.transform(F.slice(p, 2, F.size(p) - 1), one)

    opened = _parts(F.concat(F.array(F.lit(MARK)), marked))
    return F.flatten(F.transform(F.filter(opened, lambda p, i: i > 0), lambda p: bound(F.split(p, "\n", -1), out)))


def _result(out: Column, explicit: Column, heuristic: Column) -> Column:
    return F.struct(out.alias("lines"), explicit.cast("long").alias("explicit"), heuristic.cast("long").alias("heuristic"))


def alternating_lines(all_lines: Column, age: Column) -> Column:
    """_result of lines with the labels of two speakers in turn, skipped ones as they are. The doctor begins, unless the first line is a patient's opener.

    A part is a spoken line and the skipped ones after it, so that the number of the part tells who speaks.
    """

    def said(parts: Column) -> Column:
        opening = F.substring_index(F.get(parts, F.lit(1)), "\n", 1)
        sides = F.struct(parts.alias("parts"), other_side(age, opening).alias("other"), is_patient_opener(opening).cast("int").alias("shift"))
        spoken = lambda k: F.transform(F.slice(k["parts"], 2, F.size(k["parts"]) - 1), lambda p, i: one(p, i, k))
        return bound(sides, lambda k: _result(F.concat(before(k["parts"][0]), spoken(k)), F.lit(0), F.size(k["parts"]) - 1))

    def before(skipped: Column) -> Column:
        return F.when(skipped == "", F.array().cast("array<string>")).otherwise(F.array(F.substring(skipped, 2, 1 << 30)))

    def one(part: Column, i: Column, k: Column) -> Column:
        who = F.when((i + k["shift"]) % 2 == 0, F.lit(DOCTOR)).otherwise(k["other"])
        return bound(F.split(part, "\n", 2), lambda x: F.concat_ws("\n", F.concat(who, F.lit("："), strip(x[0])), F.get(x, F.lit(1))))

    opened = F.transform(all_lines, lambda x: F.when(is_skipped(x), x).otherwise(F.concat(F.lit(MARK), x)))
    return bound(_parts(F.concat(F.array(F.lit("")), opened)), said)


def label(files: DataFrame, key: str = "file_id") -> DataFrame:
    """key, text_out, changed, explicit_turns, heuristic_turns of files with key, stem and text. All on a file's own row.

    Lines already tagged in the square form count as explicit, so that labelling a labelled text changes nothing.
    A text keeps its last line's end. A null text stays null, an empty one empty, both unchanged.
    """

    def labelled(k: Column) -> Column:
        hits = F.size(F.filter(k["marked"], lambda m: m.startswith(MARK) | m.startswith(FIELD)))
        return bound(hits, lambda n: F.when(n > 0, _result(explicit_lines(k["marked"]), n, F.lit(0))).otherwise(alternating_lines(k["lines"], k["age"])))

    marked = lambda x: F.struct(x.alias("lines"), F.transform(x, _marked).alias("marked"), clinical.age_in_stem(F.col("stem")).alias("age"))
    found = F.when(F.length("text") > 0, bound(bound(lines(F.col("text")), marked), labelled))
    ending = F.when(F.col("text").endswith("\n"), F.lit("\n")).otherwise(F.lit(""))
    df = files.select(F.col(key).alias("k"), "text", bound(found, lambda f: F.struct(F.concat(F.array_join(f["lines"], "\n"), ending).alias("text_out"), f["explicit"].alias("explicit_turns"), f["heuristic"].alias("heuristic_turns"))).alias("r"))
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0)).alias(c)
    df = df.select("k", "text", F.coalesce("r.text_out", "text").alias("text_out"), zero("explicit_turns"), zero("heuristic_turns"))
    return df.select(F.col("k").alias(key), "text_out", (~F.col("text_out").eqNullSafe(F.col("text"))).alias("changed"), "explicit_turns", "heuristic_turns")


def carry_forward(rows: DataFrame, value: Column, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with the last value that isn't null so far, of those with the same by in an order: the flat form of role lines that hold for the lines after them."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(so_far))


def alternate(rows: DataFrame, first: Column, other: Column, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with two values in turn, of those with the same by in an order: the flat form of speakers who alternate."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(name, F.when(nth % 2 == 1, first).otherwise(other))


def label_counts(labelled: DataFrame) -> DataFrame:
    """One row: files, those changed, with explicit and with guessed labels, and the numbers of both."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return labelled.agg(
        F.count("*").alias("files_total"), F.count_if("changed").alias("files_changed"), F.count_if(F.col("explicit_turns") > 0).alias("files_explicit"),
        F.count_if(F.col("heuristic_turns") > 0).alias("files_heuristic"), total("explicit_turns"), total("heuristic_turns"),
    )
