"""Trimming, rounding, defaults, and the normal forms of phones, months, countries, links and slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s ﻿]"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end (Spark's trim knows only the space)."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def filled(*cs: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def fixed2(x: Column) -> Column:
    """Two decimals, rounded by the exact binary value: 0.285 -> 0.28. The error of the product x * 100 decides ties."""
    p, c = x * 100.0, x * 134217729.0
    high = c - (c - x)
    error = (high * 100.0 - p) + (x - high) * 100.0
    part = p - F.floor(p)
    up = F.when((part > 0.5) | ((part == 0.5) & (error >= 0)), 1).otherwise(0)
    return (F.floor(p) + up) / 100.0


def e164(c: Column) -> Column:
    """A phone in E.164 form: `+` numbers keep their digits, 10 digits and 1 + 10 digits are North American; else the trimmed text. Empty: null."""
    t = trimmed(c)
    core = F.regexp_replace(F.regexp_replace(t, r"(?i)\s*(x|ext\.?|#)\s*\d{1,6}$", ""), r"\(0\)", "")
    digits = F.regexp_replace(core, r"\D", "")
    n = F.length(digits)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", None)
        .when(t.startswith("+") & (n > 7), F.concat(F.lit("+"), digits))
        .when(digits.startswith("011") & (n > 10), F.concat(F.lit("+"), F.substring(digits, 4, 30)))
        .when(n == 10, F.concat(F.lit("+1"), digits))
        .when((n == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
        .otherwise(t)
    )


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAME = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def month_number(name: Column) -> Column:
    """01 to 12 for a month's name or its first three letters."""
    key = F.lower(F.substring(name, 1, 3))
    out = F.when(key == MONTHS[0], "01")
    for k, m in enumerate(MONTHS[1:], 2):
        out = out.when(key == m, f"{k:02d}")
    return out


def month(c: Column) -> Column:
    """A date as YYYY-MM; null for present, current, now, and what is no date. YYYY-MM passes as it is, whatever its month."""
    t = trimmed(c)
    take = lambda pattern, k: F.regexp_extract(t, pattern, k)
    iso = r"^(\d{4})[-/](\d{1,2})[-/]\d{1,2}(?:[T ].*)?$"
    named = rf"(?i)^(?:\d{{1,2}}\s+)?{MONTH_NAME}[a-z]*\.?,?\s+(?:\d{{1,2}},?\s+)?(\d{{4}})\b"
    word, first, last = r"^[A-Za-z]+\s+(\d{4})$", r"^(\d{4})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{4})$"
    return (
        F.when(t.rlike(r"(?i)^(present|current|now)$"), None)
        .when(t.rlike(r"^\d{4}-\d{2}$"), t)
        .when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01")))
        .when(t.rlike(iso), F.concat(take(iso, 1), F.lit("-"), F.lpad(take(iso, 2), 2, "0")))
        .when(t.rlike(named), F.concat(take(named, 2), F.lit("-"), month_number(take(named, 1))))
        .when(t.rlike(word), F.concat(take(word, 1), F.lit("-01")))
        .when(t.rlike(last), F.concat(take(last, 2), F.lit("-"), F.lpad(take(last, 1), 2, "0")))
        .when(t.rlike(first), F.concat(take(first, 1), F.lit("-"), F.lpad(take(first, 2), 2, "0")))
    )


def country(c: Column) -> Column:
    """Two letters: known long names by table, else the first two, in capitals. Empty: null."""
    t = F.upper(trimmed(c))
    # The long names.
    return (
        F.when(F.coalesce(t, F.lit("")) == "", None)
        .when(F.length(t) == 2, t)
        .when(t.isin("USA", "UNITED STATES"), "US")
        .when(t == "UNITED KINGDOM", "GB")
        .when(t == "CANADA", "CA")
        .otherwise(F.substring(t, 1, 2))
    )


def link(c: Column) -> Column:
    """An absolute URL, with https:// put before what has no scheme; null if it can't be one."""
    t = trimmed(c)
    u = F.when(t.startswith("http"), t).otherwise(F.concat(F.lit("https://"), t))
    return F.when((F.coalesce(t, F.lit("")) != "") & u.rlike(r"^https?://[^\s/?#]+[^\s]*$"), u)


def slug_name(slug: Column) -> Column:
    """A name from a profile slug: a trailing id of hex digits goes, words get a capital (their tails stay as they are)."""
    words = F.split(F.regexp_replace(slug, "-[a-f0-9]+$", ""), "-")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")


def folded(name: Column) -> Column:
    """The words of a name for comparing: lower case, dots and commas as spaces."""
    return F.filter(F.split(trimmed(F.regexp_replace(F.lower(name), "[.,]", " ")), r"\s+"), lambda w: F.length(w) > 0)


def email_list(c: Column) -> Column:
    """Trimmed, lower-case emails of an array; what has no @ is dropped, repeats stay."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda e: F.lower(trimmed(e))), lambda e: F.coalesce(e.contains("@"), F.lit(False)))


def phone_list(c: Column) -> Column:
    """E.164 phones of an array; empty ones are dropped."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), e164), lambda p: F.coalesce(p != "", F.lit(False)))


#: Rank of a source type in conflicts, the lower the better. Fixed values.
PRIORITY = {"ats_json": 0, "recruiter_csv": 1, "linkedin_json": 2, "github_api": 3, "resume_pdf": 6, "resume_docx": 6, "recruiter_notes": 7}


def priority(source_type: Column) -> Column:
    out = F.lit(99)
    for name, rank in PRIORITY.items():
        out = F.when(source_type == name, rank).otherwise(out)
    return out


def masked(uri: Column) -> Column:
    """A store's address with its password hidden."""
    return F.regexp_replace(uri, ":([^@/:]+)@", ":****@")
