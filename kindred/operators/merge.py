"""One profile of each group of records: conflicts settled by confidence and source, lists united in first-seen order, and where each value comes from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.scalars import fixed2, priority, trimmed
from kindred.plans.tables import kept, merging

#: Fields with one value, in the order in which provenance lists them.
SCALARS = ("full_name", "headline", "years_experience", "location.city", "location.region", "location.country", "links.linkedin", "links.github", "links.portfolio")
UNKNOWN = "Unknown Candidate"
#: Order of fields in provenance.
ORDER = {name: k for k, name in enumerate((*SCALARS, "links.other", "emails", "phones", "skills", "experience", "education"))}


def scalar_values(records: DataFrame, fields: tuple[str, ...] = SCALARS) -> DataFrame:
    """(group_id, rec_ord, source_id, source_type, raw_confidence, field, value): a row for each value that is there, as text."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = records.select("group_id", "rec_ord", "source_id", "source_type", "raw_confidence", F.inline(parts))
    return long.where("value is not null and value != ''")


def ranked(values: DataFrame) -> DataFrame:
    """values with the place of each in its conflict, the winning value, and how many agree with it, of how many."""
    own = Window.partitionBy("group_id", "field")
    best = own.orderBy(F.desc("raw_confidence"), priority(F.col("source_type")), "rec_ord")
    out = values.withColumn("place", F.row_number().over(best)).withColumn("winner", F.first("value").over(best)).withColumn("n", F.count("*").over(own))
    return out.withColumn("agree", F.sum(F.when(F.col("value") == F.col("winner"), 1).otherwise(0)).over(own))


def method(n: Column, agree: Column) -> Column:
    return F.when(n == 1, "direct").when(agree * 2 > n, "merged_majority").otherwise("merged_priority")


def resolved(values: DataFrame) -> DataFrame:
    """(group_id, field, value, method): the value of the surest source; ties go by source type, then by order."""
    return _winners(ranked(values))


def _winners(told: DataFrame) -> DataFrame:
    return told.where("place = 1").select("group_id", "field", "value", method(F.col("n"), F.col("agree")).alias("method"))


def scalar_provenance(values: DataFrame) -> DataFrame:
    """(group_id, field, idx, seq, source, method): the winner and all sources that disagree with it, surest first."""
    return _conflicts(ranked(values))


def _conflicts(told: DataFrame) -> DataFrame:
    return told.where("place = 1 or value != winner").select("group_id", "field", F.lit(-1).alias("idx"), F.col("place").cast("long").alias("seq"), F.col("source_id").alias("source"), method(F.col("n"), F.col("agree")).alias("method"))


def occurrences(records: DataFrame, column: str) -> DataFrame:
    """(group_id, rec_ord, pos, source_id, value) of the elements of an array column."""
    return records.select("group_id", "rec_ord", "source_id", F.posexplode(column).alias("pos", "value"))


def united(found: DataFrame, by: str = "value") -> DataFrame:
    """(group_id, value, idx): the distinct values of each group, numbered from 0 in the order in which they are first seen."""
    seen = found.groupBy("group_id", by).agg(F.min(F.struct("rec_ord", "pos")).alias("first"))
    return seen.withColumn("idx", F.row_number().over(Window.partitionBy("group_id").orderBy("first")) - 1)


def listed(found: DataFrame, name: str) -> DataFrame:
    """(group_id, name): the distinct values of each group as an array in first-seen order."""
    rows = united(found).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("rows"))
    return rows.select("group_id", F.transform("rows", lambda r: r["value"]).alias(name))


def list_provenance(found: DataFrame, name: str) -> DataFrame:
    """A row for each element and occurrence; the method is always `direct`. seq: record and place."""
    return found.join(merging(united(found).select("group_id", "value", "idx")), ["group_id", "value"]).select("group_id", F.lit(name).alias("field"), "idx", F.struct("rec_ord", F.col("pos").cast("long").alias("pos")).alias("seq"), F.col("source_id").alias("source"), F.lit("direct").alias("method"))


def candidate_ids(records: DataFrame) -> DataFrame:
    """(group_id, candidate_id): md5 of the first email in record order, else of the first name, else of `unknown`."""
    email = records.where(F.size("emails") > 0).groupBy("group_id").agg(F.min_by(F.col("emails")[0], "rec_ord").alias("email"))
    name = records.groupBy("group_id").agg(F.min(F.when(F.col("full_name") != "", F.struct("rec_ord", "full_name")))["full_name"].alias("name"))
    return name.join(merging(email), "group_id", "left").select("group_id", F.md5(F.coalesce("email", "name", F.lit("unknown"))).alias("candidate_id"))


def skill_occurrences(records: DataFrame) -> DataFrame:
    return records.select("group_id", "rec_ord", "source_id", F.posexplode("skills").alias("pos", "skill")).select("group_id", "rec_ord", "pos", "source_id", F.col("skill.name").alias("value"), F.col("skill.confidence").alias("confidence"))


def _in_order(pairs: str, what: str) -> Column:
    """The distinct values of an array of structs (first, ...), in the order in which they are first seen."""
    return F.array_distinct(F.transform(F.array_sort(pairs), lambda r: r[what]))


def merged_skills(found: DataFrame) -> DataFrame:
    """(group_id, value, idx, confidence, sources): the mean of all occurrences, 0.1 more for two sources or more, at most 1.

    Confidences are added up in the order of the occurrences, as a running sum, which takes no memory however many there are; only
    the distinct sources of a value are gathered.
    """
    own, at = ["group_id", "value"], F.struct("rec_ord", "pos")
    running = F.sum("confidence").over(Window.partitionBy(*own).orderBy("rec_ord", "pos").rowsBetween(Window.unboundedPreceding, 0))
    by = found.withColumn("sum", running).groupBy(*own, "source_id").agg(F.min(at).alias("first"), F.max(F.struct("rec_ord", "pos", "sum")).alias("last"), F.count("*").alias("n"))
    told = by.groupBy(*own).agg(F.min("first").alias("first"), F.max("last")["sum"].alias("sum"), F.sum("n").alias("n"), F.collect_list(F.struct("first", "source_id")).alias("pairs"))
    told = told.withColumn("sources", _in_order("pairs", "source_id"))
    bonus = F.when(F.size("sources") >= 2, 0.1).otherwise(0.0)
    told = told.withColumn("confidence", F.least(F.lit(1.0), fixed2(F.col("sum") / F.col("n") + bonus)))
    return told.withColumn("idx", F.row_number().over(Window.partitionBy("group_id").orderBy("first")) - 1).select(*own, "idx", "confidence", "sources")


def _fold(c: Column) -> Column:
    return trimmed(F.lower(F.coalesce(c, F.lit(""))))


def merged_experience(found: DataFrame) -> DataFrame:
    """Jobs (group_id, rec_ord, pos, source_id, company, title, start, end, summary) united by company and title.

    The earliest start and the latest end count; a summary is added on a line of its own unless it is in what there is. Jobs
    with neither company nor title stay apart.
    """
    keyed = found.withColumn("k1", _fold(F.col("company"))).withColumn("k2", _fold(F.col("title")))
    keyed = keyed.withColumn("k3", F.when((F.col("k1") == "") & (F.col("k2") == ""), F.struct("rec_ord", "pos")))
    own, at = ["group_id", "k1", "k2", "k3"], F.struct("rec_ord", "pos")
    first = lambda c, of: F.min_by(c, of).alias(c)
    # Of equal summaries from one source the first is enough, as others are in what there is.
    by = keyed.groupBy(*own, "source_id", "summary").agg(F.min(at).alias("first"), first("company", at), first("title", at), F.min("start").alias("start"), F.max("end").alias("end"))
    told = by.groupBy(*own).agg(F.min("first").alias("first"), first("company", "first"), first("title", "first"), F.min("start").alias("start"), F.max("end").alias("end"), F.collect_list(F.struct("first", "source_id", "summary")).alias("rows"))
    told = told.withColumn("sources", _in_order("rows", "source_id")).withColumn("rows", F.array_sort("rows"))
    add = lambda acc, r: F.when(F.coalesce(r["summary"], F.lit("")) == "", acc).when(F.coalesce(acc, F.lit("")) == "", r["summary"]).when(acc.contains(r["summary"]), acc).otherwise(F.concat(acc, F.lit("\n"), r["summary"]))
    told = told.withColumn("summary", F.aggregate("rows", F.col("rows")[0]["summary"], add))
    told = told.withColumn("idx", F.row_number().over(Window.partitionBy("group_id").orderBy("first")) - 1)
    return told.select("group_id", "idx", "company", "title", "start", "end", "summary", "sources")


def merged_education(found: DataFrame) -> DataFrame:
    """Schools (group_id, rec_ord, pos, source_id, institution, degree, field, end_year) united by institution and degree; the first field and year that are there count."""
    keyed = found.withColumn("k1", _fold(F.col("institution"))).withColumn("k2", _fold(F.col("degree")))
    keyed = keyed.withColumn("k3", F.when((F.col("k1") == "") & (F.col("k2") == ""), F.struct("rec_ord", "pos")))
    own, at = ["group_id", "k1", "k2", "k3"], F.struct("rec_ord", "pos")
    there = lambda c, ok: F.min(F.when(ok, F.struct("rec_ord", "pos", c))).alias(c)
    first = lambda c, of: F.min_by(c, of).alias(c)
    by = keyed.groupBy(*own, "source_id").agg(F.min(at).alias("first"), first("institution", at), first("degree", at), there("field", F.coalesce(F.col("field"), F.lit("")) != ""), there("end_year", F.coalesce(F.col("end_year"), F.lit(0)) != 0))
    told = by.groupBy(*own).agg(F.min("first").alias("first"), first("institution", "first"), first("degree", "first"), F.min("field")["field"].alias("field"), F.min("end_year")["end_year"].alias("end_year"), F.collect_list(F.struct("first", "source_id")).alias("rows"))
    told = told.withColumn("idx", F.row_number().over(Window.partitionBy("group_id").orderBy("first")) - 1)
    return told.select("group_id", "idx", "institution", "degree", "field", "end_year", _in_order("rows", "source_id").alias("sources"))


def united_provenance(merged: DataFrame, name: str) -> DataFrame:
    """A row for each element and source; `merged_majority` if there are two sources or more."""
    told = F.when(F.size("sources") >= 2, "merged_majority").otherwise("direct")
    return merged.select("group_id", F.lit(name).alias("field"), "idx", told.alias("method"), F.posexplode("sources").alias("seq", "source")).select("group_id", "field", "idx", F.col("seq").cast("long").alias("seq"), "source", "method")


@dataclass
class Parts:
    """What profiles and their provenance are both made of."""

    ranked: DataFrame
    skills: DataFrame
    experience: DataFrame
    education: DataFrame


def parts_of(records: DataFrame) -> Parts:
    """The parts of records with group_id, each worked out once and written: plans that hold them several times outgrow the driver."""
    return Parts(
        kept(ranked(scalar_values(records)), "ranked"), kept(merged_skills(skill_occurrences(records)), "skills"),
        kept(merged_experience(jobs_of(records)), "experience"), kept(merged_education(schools_of(records)), "education"),
    )


def provenance(records: DataFrame, parts: Parts | None = None) -> DataFrame:
    """(group_id, field, idx, seq, source, method) of all fields; seq is a struct, by which an element's sources are ordered. Locations count only if a group has one."""
    parts = parts or parts_of(records)
    own = [_conflicts(parts.ranked), united_provenance(parts.skills, "skills"), united_provenance(parts.experience, "experience"), united_provenance(parts.education, "education")]
    rows = [p.withColumn("seq", F.struct(F.col("seq").alias("rec_ord"), F.lit(0).cast("long").alias("pos"))) for p in own]
    rows += [list_provenance(occurrences(records, name), name) for name in ("links.other", "emails", "phones")]
    out = rows[0]
    for p in rows[1:]:
        out = out.unionByName(p)
    return out


def jobs_of(records: DataFrame) -> DataFrame:
    return records.select("group_id", "rec_ord", "source_id", F.posexplode("experience").alias("pos", "job")).select("group_id", "rec_ord", "pos", "source_id", "job.company", "job.title", "job.start", "job.end", "job.summary")


def schools_of(records: DataFrame) -> DataFrame:
    return records.select("group_id", "rec_ord", "source_id", F.posexplode("education").alias("pos", "school")).select("group_id", "rec_ord", "pos", "source_id", "school.institution", "school.degree", "school.field", "school.end_year")


def field_path(field: Column, idx: Column) -> Column:
    return F.when(idx < 0, field).otherwise(F.concat(field, F.lit("["), idx, F.lit("]")))


def profiles(records: DataFrame, parts: Parts | None = None, told: DataFrame | None = None) -> DataFrame:
    """The canonical profile of each group, with overall_confidence 1.0 (see kindred.operators.confidence). told: their provenance, if it is there."""
    parts = parts or parts_of(records)
    told = provenance(records, parts) if told is None else told
    values = _winners(parts.ranked)
    wide = values.groupBy("group_id").pivot("field", list(SCALARS)).agg(F.first("value"))
    out = candidate_ids(records).join(merging(wide), "group_id", "left")
    sorted_list = lambda df, name, item: df.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("idx", item.alias("item")))).alias("rows")).select("group_id", F.transform("rows", lambda r: r["item"]).alias(name))
    lists = [listed(occurrences(records, c), n) for c, n in (("emails", "emails"), ("phones", "phones"), ("links.other", "other_links"))]
    lists.append(sorted_list(parts.skills, "skills", F.struct(F.col("value").alias("name"), "confidence", "sources")))
    lists.append(sorted_list(parts.experience, "experience", F.struct("company", "title", "start", "end", "summary")))
    lists.append(sorted_list(parts.education, "education", F.struct("institution", "degree", "field", "end_year")))
    rank = F.lit(len(ORDER))
    for name, k in ORDER.items():
        rank = F.when(F.col("field") == name, k).otherwise(rank)
    rows = told.withColumn("rank", rank).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("rank", "idx", "seq", "field", "source", "method"))).alias("rows"))
    lists.append(rows.select("group_id", F.transform("rows", lambda r: F.struct(field_path(r["field"], r["idx"]).alias("field"), r["source"].alias("source"), r["method"].alias("method"))).alias("provenance")))
    for df in lists:
        out = out.join(merging(df), "group_id", "left")
    col = lambda name: F.col(f"`{name}`")
    place = F.struct(*[col(f"location.{k}").alias(k) for k in ("city", "region", "country")])
    blank = lambda name: F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType)).alias(name)
    return out.select(
        "group_id", "candidate_id", F.coalesce(col("full_name"), F.lit(UNKNOWN)).alias("full_name"), blank("emails"), blank("phones"),
        F.when(F.coalesce(*[col(f"location.{k}") for k in ("city", "region", "country")]).isNotNull(), place).alias("location"),
        F.struct(*[col(f"links.{k}").alias(k) for k in ("linkedin", "github", "portfolio")], blank("other_links").alias("other")).alias("links"),
        col("headline").alias("headline"), col("years_experience").cast("double").alias("years_experience"),
        blank("skills"), blank("experience"), blank("education"), blank("provenance"), F.lit(1.0).alias("overall_confidence"),
    )
