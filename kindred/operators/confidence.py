"""How sure a profile is: field by field from the sources that told it, and overall as a weighted mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.scalars import fixed2
from kindred.operators import merge
from kindred.operators.merge import UNKNOWN
from kindred.plans.tables import kept, merging

# Fixed values.
WEIGHTS = {"full_name": 0.20, "emails": 0.15, "phones": 0.15, "location": 0.10, "links": 0.10, "skills": 0.10, "headline": 0.05, "years_experience": 0.05, "experience": 0.05, "education": 0.05}
UNSURE, BONUS = 0.5, 0.1


def source_confidence(records: DataFrame) -> DataFrame:
    """(source_id, confidence): of a source that comes more than once, the last."""
    return records.groupBy("source_id").agg(F.max_by("raw_confidence", "rec_ord").alias("confidence"))


def mean_of(confidences: Column) -> Column:
    """The mean in the array's order, 0.1 more for two or more, at most 1, two decimals; 0 for none."""
    total = F.aggregate(confidences, F.lit(0.0), lambda s, x: s + x) / F.size(confidences)
    return F.when(F.size(confidences) == 0, 0.0).otherwise(F.least(F.lit(1.0), fixed2(total + F.when(F.size(confidences) >= 2, BONUS).otherwise(0.0))))


def field_confidences(provenance: DataFrame, sources: DataFrame) -> DataFrame:
    """(group_id, field, confidence) from provenance rows (group_id, field, idx, seq, source) and source confidences; unknown and 0 count as 0.5."""
    told = provenance.join(merging(sources.withColumnRenamed("source_id", "source")), "source", "left")
    told = told.withColumn("confidence", F.when(F.coalesce("confidence", F.lit(0.0)) == 0.0, UNSURE).otherwise(F.col("confidence")))
    each = told.groupBy("group_id", "field", "source").agg(F.min(F.struct("idx", "seq")).alias("at"), F.first("confidence").alias("confidence"))
    rows = each.groupBy("group_id", "field").agg(F.array_sort(F.collect_list(F.struct("at", "source", "confidence"))).alias("rows"))
    return rows.select("group_id", "field", mean_of(F.transform("rows", lambda r: r["confidence"])).alias("confidence"))


def populated(field: str) -> Column:
    c = F.col(field)
    if field == "full_name":
        return F.coalesce((c != "") & (c != UNKNOWN), F.lit(False))
    if field == "links":
        return F.coalesce(c["linkedin"], c["github"], c["portfolio"]).isNotNull() | (F.size(c["other"]) > 0)
    if field in ("emails", "phones", "skills", "experience", "education"):
        return F.size(c) > 0
    return c.isNotNull()


def overall(field: dict[str, Column]) -> Column:
    """The weighted mean over populated fields, halved for want of a name or of both email and phone."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in WEIGHTS.items():
        total = total + F.when(populated(name), field[name] * w).otherwise(0.0)
        weight = weight + F.when(populated(name), w).otherwise(0.0)
    share = (F.when(populated("full_name"), 1.0).otherwise(0.0) + F.when(populated("emails") | populated("phones"), 1.0).otherwise(0.0)) / 2.0
    return fixed2(F.when(weight > 0, F.try_divide(total, weight)).otherwise(0.0) * share)


def scored(profiles: DataFrame, provenance: DataFrame, records: DataFrame) -> DataFrame:
    """profiles with their overall confidence, worked out by joins of provenance with the sources."""
    names = ("full_name", "emails", "phones", "headline", "years_experience", "experience", "education", "location.city", "location.region", "location.country", "links.linkedin", "links.github", "links.portfolio", "links.other")
    wide = field_confidences(provenance, source_confidence(records)).groupBy("group_id").pivot("field", list(names)).agg(F.first("confidence"))
    out = profiles.join(merging(wide.select(F.col("group_id"), *[F.col(f"`{n}`").alias(f"__{n.replace('.', '_')}") for n in names])), "group_id", "left")
    c = lambda n: F.coalesce(F.col(f"__{n.replace('.', '_')}"), F.lit(0.0))
    skills = F.aggregate("skills", F.lit(0.0), lambda s, x: s + x["confidence"])
    field = {n: c(n) for n in ("full_name", "emails", "phones", "headline", "years_experience", "experience", "education")}
    field |= {"location": (c("location.city") + c("location.region") + c("location.country")) / 3.0, "links": (c("links.linkedin") + c("links.github") + c("links.portfolio") + c("links.other")) / 4.0}
    field |= {"skills": F.when(F.size("skills") > 0, fixed2(F.try_divide(skills, F.size("skills")))).otherwise(0.0)}
    return out.withColumn("overall_confidence", overall(field)).select(*profiles.columns)


def scored_profiles(records: DataFrame) -> DataFrame:
    """The canonical profiles of records with group_id, with their confidence. records: a written table, as it is read many times."""
    parts = merge.parts_of(records)
    told = kept(merge.provenance(records, parts), "provenance")
    return scored(merge.profiles(records, parts, told), told, records)
