"""Columns for showing profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "REFINED").when(confidence >= 0.5, "STABLE").otherwise("UNSTABLE")


def badge(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "green").when(confidence >= 0.5, "orange").otherwise("red")


def source_family(source_id: Column) -> Column:
    s = F.lower(source_id)
    return (
        F.when(s.contains("csv"), "csv").when(s.contains("ats") | (s.contains("json") & ~s.contains("linkedin")), "ats").when(s.contains("github"), "github")
        .when(s.contains("linkedin"), "linkedin").when(s.contains("pdf") | s.contains("docx") | s.contains("resume"), "resume")
        .when(s.contains("notes") | s.contains("txt"), "notes").otherwise("other")
    )


def skill_hue(confidence: Column) -> Column:
    return 38 + F.when(F.coalesce(confidence, F.lit(0.0)) == 0, 0.5).otherwise(confidence) * 140


def month_label(month: Column) -> Column:
    """`Mon YYYY` of YYYY-MM; Present stays."""
    names = F.split(F.lit("Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec"), ",")
    number = F.substring(month, 6, 2).try_cast("int")
    return F.when(month == "Present", month).when(month.rlike(r"^\d{4}-\d{2}$"), F.concat(F.get(names, number - 1), F.lit(" "), F.substring(month, 1, 4))).otherwise(month)


def percent(confidence: Column) -> Column:
    return F.floor(confidence * 100 + 0.5).cast("int")


def shortened(text: Column, most: int = 150) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def run_label(run_id: Column) -> Column:
    return F.upper(F.right(run_id, F.lit(6)))
