"""Résumés and notes as text: sections, blocks of lines, jobs and schools. All of it works on arrays of lines, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.functions.scalars import trimmed

#: Lines after a section's heading that are looked at.
EXPERIENCE_LINES, EDUCATION_LINES = 59, 29
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Words that open a section and words that end it.
EXPERIENCE = rf"{_B}(experience|work history|employment|professional history){_E}"
EDUCATION = rf"{_B}(education|academic history|studies){_E}"
AFTER_EXPERIENCE = r"(?i)education|skills|projects|interests|certifications|achievements"
AFTER_EDUCATION = r"(?i)experience|skills|work history|projects|certifications|achievements"
SCHOOL = r"(?i)university|college|school|institute"
# Degrees by the words that tell them, looked for in this order.
DEGREES = (
    ("Bachelor", rf"(?i){_B}(bachelor|b\.?tech|b\.?e|b\.?s|b\.?a){_E}"),
    ("Master", rf"(?i){_B}(master|m\.?tech|m\.?s|m\.?a|mba){_E}"),
    ("PhD", rf"(?i){_B}(ph\.?d|doctorate){_E}"),
    ("Secondary/Intermediate", rf"(?i){_B}(intermediate|high school|secondary|10th|12th|diploma){_E}"),
)
# Fixed value: what opens a line of a list.
BULLET = r"^[•\-*◦]"


def blocks_of(lines: Column, opens: Callable[[Column], Column]) -> Column:
    """array<struct<first, lines>>: a block runs from a line that opens one to before the next; what comes before the first is left out."""

    def cut(ls: Column) -> Column:
        heads = F.array_compact(F.transform(ls, lambda x, k: F.when(opens(x), k)))
        part = lambda hs: F.transform(hs, lambda h, k: F.struct(h.alias("first"), F.slice(ls, h + 1, F.coalesce(F.get(hs, k + 1), F.size(ls)) - h).alias("lines")))
        return text.let(heads, part)

    return text.let(lines, cut)


def section(whole: Column, heading: str, most: int, stop: str) -> Column:
    """The lines after a section's heading, up to a line that begins another section."""
    at = F.regexp_instr(F.lower(whole), F.lit(heading))

    def upto(found: Column) -> Column:
        ends = F.array_compact(F.transform(found, lambda x, k: F.when(x.rlike(stop), k)))
        return F.slice(found, 1, F.coalesce(F.get(ends, F.lit(0)), F.size(found)))

    return F.when(at > 0, text.let(F.slice(text.lines(F.substring(whole, at, F.length(whole))), 2, most), upto)).otherwise(F.array().cast("array<string>"))


def _cut(line: Column, span: Column) -> Column:
    """The line without its date and without brackets that are left empty."""
    rest = F.when(span.isNotNull(), F.concat(F.substring(line, F.lit(1), F.instr(line, span) - 1), F.substring(line, F.instr(line, span) + F.length(span), F.length(line)))).otherwise(line)
    return trimmed(F.regexp_replace(F.regexp_replace(rest, r"\(\s*\)", ""), r"\[\s*\]", ""))


def _job(block: Column) -> Column:
    head, rest = block["lines"][0], F.slice(block["lines"], 2, 1000)
    empty = text.some

    def dated(date: Column) -> Column:
        clean = trimmed(F.regexp_replace(_cut(head, date["span"]), r"[-–—,@|]+$", ""))
        parts = lambda c: F.filter(F.split(c, rf"(?i)\s*(?:[-–—@,|]|{_B}at{_E})\s*"), lambda p: p != "")
        return text.let(F.struct(clean.alias("clean"), parts(clean).alias("parts")), lambda h: told(date, h))

    def told(date: Column, h: Column) -> Column:
        split = F.size(h["parts"]) >= 2
        next_ = F.get(rest, F.lit(0))
        plain = next_.isNotNull() & ~next_.rlike(BULLET) & text.date_range(next_)["start"].isNull()

        def with_next(takes: Column) -> Column:
            company = F.when(split, trimmed(F.get(h["parts"], F.lit(1)))).when(takes, trimmed(F.get(F.split(next_, ","), F.lit(0))))
            more = F.slice(rest, F.when(takes, 2).otherwise(1), 1000)
            summary = F.array_join(F.filter(F.transform(more, lambda x: trimmed(F.regexp_replace(x, rf"{BULLET}\s*", ""))), lambda x: x != ""), " ")
            title = F.when(split, trimmed(F.get(h["parts"], F.lit(0)))).otherwise(h["clean"])
            return F.struct(empty(company).alias("company"), empty(title).alias("title"), date["start"].alias("start"), date["end"].alias("end"), empty(summary).alias("summary"))

        return text.let(~split & F.coalesce(plain, F.lit(False)), with_next)

    return text.let(text.date_range(head), dated)


def _year(line: Column) -> Column:
    year = lambda d: F.when(d["end"].isNotNull() & (d["end"] != "Present"), F.substring(d["end"], 1, 4)).otherwise(F.substring(d["start"], 1, 4)).try_cast("int")
    return text.let(text.date_range(line), year)


def _degree(line: Column) -> Column:
    out = F.when(line.rlike(DEGREES[0][1]), DEGREES[0][0])
    for name, pattern in DEGREES[1:]:
        out = out.when(line.rlike(pattern), name)
    return out


def _study(line: Column) -> Column:
    """The field of study that a degree's line tells: in brackets, after `in`, or after a comma; grades are none."""
    # What leads to a field of study and what ends it.
    tail = r"\s+([A-Za-z][A-Za-z\s&]+?)(?:\s*[;(),]|\s*(?:CGPA|GPA|Score)|\s*\(|$)"
    inside = text.let(F.regexp_extract(line, r"\(([^)]+)\)", 1), lambda x: F.when((x != "") & x.rlike(r"[A-Za-z]{3,}") & ~x.rlike(text.YEAR), trimmed(x)))
    after = lambda mark: text.some(trimmed(F.regexp_extract(line, mark, 1)))
    found = F.coalesce(inside, after(rf"(?i){_B}in{tail}"), after(rf"(?i),{tail.replace('+(', '*(', 1)}"))
    return text.let(found, lambda x: F.when(~x.rlike(r"(?i)cgpa|gpa|score|grade|marks|division") & ~x.rlike(r"^\d"), x))


def _school(block: Column) -> Column:
    head, rest = block["lines"][0], F.slice(block["lines"], 2, 1000)
    looked = F.slice(block["lines"], 1, 3)
    degrees = F.filter(F.transform(looked, lambda x: F.struct(_degree(x).alias("degree"), x.alias("line"))), lambda d: d["degree"].isNotNull())
    years = F.filter(F.transform(rest, _year), lambda y: y.isNotNull())
    clean = text.let(text.date_range(head), lambda d: _cut(head, d["span"]))
    told = lambda d: F.struct(
        text.some(trimmed(F.get(F.split(clean, ",|-|—|–"), F.lit(0)))).alias("institution"), d["degree"].alias("degree"),
        text.let(F.coalesce(d["line"], F.get(rest, F.lit(0)), F.lit("")), _study).alias("field"), F.coalesce(_year(head), F.get(years, F.lit(0))).alias("end_year"),
    )
    return text.let(F.get(degrees, F.lit(0)), told)


def experience(whole: Column) -> Column:
    dated = lambda x: text.date_range(x)["start"].isNotNull() & ~x.rlike(BULLET)
    return F.transform(blocks_of(section(whole, EXPERIENCE, EXPERIENCE_LINES, AFTER_EXPERIENCE), dated), _job)


def education(whole: Column) -> Column:
    return F.transform(blocks_of(section(whole, EDUCATION, EDUCATION_LINES, AFTER_EDUCATION), lambda x: x.rlike(SCHOOL)), _school)


def fields(whole: Column) -> Column:
    """What a résumé tells: name, emails, phones, links, skills, experience, education."""
    return F.struct(
        text.name(text.lines(whole)).alias("name"), text.emails(whole).alias("emails"), text.phones(whole).alias("phones"), text.links(whole).alias("links"),
        text.keywords(whole).alias("skills"), experience(whole).alias("experience"), education(whole).alias("education"),
    )
