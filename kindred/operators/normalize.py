"""Raw records to normal ones: one name, lower-case emails, E.164 phones, months, known skills, full links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import fuzzy
from kindred.functions.scalars import country, email_list, filled, link, month, phone_list, trimmed

NO_COMPANY, NO_TITLE, NO_SCHOOL = "Unknown Company", "Software Engineer", "Unknown Institution"


def _list(many: Column, one: Column) -> Column:
    return F.coalesce(many, F.when(F.coalesce(one, F.lit("")) != "", F.array(one)), F.array().cast("array<string>"))


def skill_names(raw: DataFrame) -> DataFrame:
    """(skill, name, confidence) of the distinct skills of raw records: each is looked up once."""
    f = F.col("fields")
    words = raw.select(F.explode(F.coalesce(f["skills"], f["languages"])).alias("skill")).distinct()
    return words.withColumn("s", fuzzy.skill(F.col("skill"))).select("skill", "s.name", "s.confidence")


def hint(name: Column, emails: Column, phones: Column) -> Column:
    """Who a record may be of: its name, first email and first phone."""
    return F.struct(name.alias("name"), F.get(emails, F.lit(0)).alias("email"), F.get(phones, F.lit(0)).alias("phone"))


def record_faults(f: Column) -> Column:
    """array<string>: the lists of raw fields that have a null among their members, which has no normal form."""
    lists = {"experience": f["experience"], "education": f["education"], "skills": F.coalesce(f["skills"], f["languages"])}
    return F.array_compact(F.array(*[F.when(F.exists(c, lambda x: x.isNull()), name) for name, c in lists.items()]))


def passed_on(out: DataFrame, f: Column) -> DataFrame:
    """out, in which records with faults have their raw values: as they were told, but for nulls in lists."""
    faulty = F.size("faults") > 0
    job, school = ("company", "title", "start", "end", "summary"), ("institution", "degree", "field")
    jobs = F.transform(F.array_compact(f["experience"]), lambda j: F.struct(*[j[n].alias(n) for n in job]))
    schools = F.transform(F.array_compact(f["education"]), lambda s: F.struct(*[s[n].alias(n) for n in school], s["end_year"].try_cast("int").alias("end_year")))
    told = {"emails": F.array_compact(_list(f["emails"], f["email"])), "phones": F.array_compact(_list(f["phones"], f["phone"])), "experience": jobs, "education": schools}
    return out.withColumns({n: F.when(faulty, F.coalesce(c, F.array().cast(out.schema[n].dataType))).otherwise(F.col(n)) for n, c in told.items()})


def normalized(raw: DataFrame, keep_current_job: bool = False, resume_links: bool = False) -> DataFrame:
    """raw (rec_ord, source_id, source_type, raw_confidence, fields) in the normal form. A skills list, even an empty one, comes before languages.

    A place that is told as a record comes before its single members. `faults` names the lists that can't be normalized; the emails,
    phones, jobs and schools of such a record are passed on as they are told, and it takes part in all further steps.
    """
    f = F.col("fields")
    flat = {n: f[n] for n in ("city", "region", "country")}
    if "location" in raw.schema["fields"].dataType.names:
        flat = {n: F.when(f["location"].isNotNull(), f["location"][n]).otherwise(c) for n, c in flat.items()}
    nested = lambda k: F.coalesce(f[k], f["links"][k]) if resume_links else f[k]
    other = F.coalesce(f["other_links"], f["links"]["other"]) if resume_links else f["other_links"]
    place = F.struct(trimmed(flat["city"]).alias("city"), trimmed(flat["region"]).alias("region"), country(flat["country"]).alias("country"))
    jobs = F.transform(F.coalesce(f["experience"], F.array().cast(raw.schema["fields"].dataType["experience"].dataType)), lambda j: F.struct(trimmed(filled(j["company"], F.lit(NO_COMPANY))).alias("company"), trimmed(filled(j["title"], F.lit(NO_TITLE))).alias("title"), month(j["start"]).alias("start"), month(j["end"]).alias("end"), F.nullif(trimmed(j["summary"]), F.lit("")).alias("summary")))
    if keep_current_job:
        own = F.array(F.struct(trimmed(f["current_company"]).alias("company"), trimmed(filled(f["title"], F.lit(NO_TITLE))).alias("title"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("summary")))
        jobs = F.when(filled(f["current_company"]).isNotNull(), F.concat(jobs, own)).otherwise(jobs)
    schools = F.transform(F.coalesce(f["education"], F.array().cast(raw.schema["fields"].dataType["education"].dataType)), lambda s: F.struct(trimmed(filled(s["institution"], F.lit(NO_SCHOOL))).alias("institution"), trimmed(s["degree"]).alias("degree"), trimmed(s["field"]).alias("field"), F.regexp_extract(s["end_year"], r"^\s*([+-]?\d+)", 1).try_cast("int").alias("end_year")))
    out = raw.select(
        "rec_ord", "source_id", "source_type", "raw_confidence", trimmed(f["name"]).alias("full_name"), email_list(_list(f["emails"], f["email"])).alias("emails"), phone_list(_list(f["phones"], f["phone"])).alias("phones"),
        F.when(F.coalesce(*[filled(c) for c in flat.values()]).isNotNull(), place).alias("location"),
        F.struct(link(nested("linkedin")).alias("linkedin"), link(nested("github")).alias("github"), link(nested("portfolio")).alias("portfolio"), F.array_compact(F.transform(F.coalesce(other, F.array().cast("array<string>")), link)).alias("other")).alias("links"),
        filled(f["headline"], f["bio"]).alias("headline"), f["years_experience"].alias("years_experience"), F.coalesce(f["skills"], f["languages"]).alias("raw_skills"), jobs.alias("experience"), schools.alias("education"), record_faults(f).alias("faults"), f.alias("__fields"),
    )
    out = passed_on(out, F.col("__fields")).drop("__fields")
    out = out.withColumn("candidate_hint", hint(F.col("full_name"), F.col("emails"), F.col("phones")))
    found = out.select("rec_ord", F.posexplode("raw_skills").alias("pos", "skill")).join(skill_names(raw), "skill").where("name != '' and name != 'Unknown'")
    skills = found.groupBy("rec_ord").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "confidence"))).alias("rows")).select("rec_ord", F.transform("rows", lambda r: F.struct(r["name"].alias("name"), r["confidence"].alias("confidence"))).alias("skills"))
    out = out.drop("raw_skills").join(skills, "rec_ord", "left")
    return out.withColumn("skills", F.coalesce("skills", F.array().cast("array<struct<name:string,confidence:double>>"))).withColumn("companies", F.transform("experience", lambda j: j["company"]))
