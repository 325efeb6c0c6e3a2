"""A whole run: sources to profiles in a declared shape."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import cluster, confidence, extract, normalize
from kindred.plans.config import DEFAULT, KindredError, OutputConfig
from kindred.plans.project import accepted, canonical_faults, checked, projected
from kindred.plans.shape import with_faults
from kindred.plans.store import Store
from kindred.plans.tables import kept
from kindred.sources import readers
from kindred.sources.detect import detect_sources


@dataclass
class PipelineResult:
    raw: DataFrame
    canonical: DataFrame
    projected: DataFrame
    warnings: DataFrame
    run_id: str = "no-persist-run"


def typed_text(sources: DataFrame) -> DataFrame:
    """sources with their type and text, without the content; PDF and DOCX are read in tasks, other content is plain text."""
    typed = detect_sources(sources)
    binary = F.col("source_type").isin("resume_pdf", "resume_docx")
    parsed = F.arrow_udf(readers.documents_text, "string")(F.col("content"), F.col("source_type"))
    plain = typed.where(~binary)
    return plain.unionByName(typed.where(binary).withColumn("text", parsed)).drop("content")


def warnings_of(raw: DataFrame, records: DataFrame, judged: DataFrame, out: DataFrame) -> DataFrame:
    """(stage, subject, message) of what went wrong, each fault with the record or profile that has it."""
    told = lambda rows, stage, subject, message: rows.select(F.lit(stage).alias("stage"), F.col(subject).cast("string").alias("subject"), message.alias("message"))
    faults, faulty = F.array_join("faults", ", "), F.size("faults") > 0
    parts = [
        told(raw.where("raw_confidence = 0"), "extract", "source_id", F.lit("Nothing could be extracted")),
        told(records.where(faulty), "normalize", "source_id", F.concat(F.lit("Passed on as told, nothing where a member should be: "), faults)),
        told(judged.where(faulty), "validate", "candidate_id", F.concat(F.lit("Invalid profile: "), faults)),
        told(out, "project", "group_id", F.explode("warnings")),
        told(out.where(faulty), "shape", "group_id", F.concat(F.lit("Against the declared shape: "), faults)),
    ]
    return reduce(DataFrame.unionByName, parts)


def raw_tables(typed: DataFrame, csv: DataFrame | None = None) -> DataFrame:
    """The raw records of typed sources and of CSV lines, written kind by kind: a plan holds one extractor, and none of a kind that no source has."""
    kinds = sorted(r.source_type for r in typed.select("source_type").distinct().collect())  # of TYPES, so a few
    parts = [kept(p, "raw") for p in extract.raw_parts(typed, csv, kinds)]
    return reduce(DataFrame.unionByName, parts)


def run_pipeline(spark: SparkSession, sources: DataFrame, config: OutputConfig = DEFAULT, store: Store | None = None, github: DataFrame | None = None, linkedin: DataFrame | None = None, csv: DataFrame | None = None) -> PipelineResult:
    """Detects, extracts, normalizes, clusters, merges, scores, checks and projects.

    github: fetched profiles as the `github_profiles` reader gives them; linkedin: stored profiles (slug, body). Both are joined to
    the sources that are links to them. csv: the lines of CSV files, as `csv_lines` reads them. A link without a profile gives an empty record, or one by its slug, and a warning.
    """
    if csv is None and sources.isEmpty():
        raise KindredError("MISSING_INPUT", "there are no sources", 400)
    run_id = store.start(config) if store else "no-persist-run"
    try:
        typed = typed_text(sources)
        if linkedin is not None:
            typed = extract.with_fixtures(typed, linkedin)
        if github is not None:
            typed = extract.with_profiles(typed, github)
        raw = raw_tables(kept(typed, "typed"), csv)
        records = kept(normalize.normalized(raw), "records")
        grouped = cluster.cluster(records)
        judged = kept(canonical_faults(confidence.scored_profiles(grouped)), "profiles")
        good = judged.where(F.size("faults") == 0).drop("faults")
        out = with_faults(checked(projected(good, config, ("group_id",)), config), config)
        shaped = accepted(out).orderBy("group_id").drop("group_id", "warnings", "faults")
        warnings = warnings_of(raw, records, judged, out)
        if store:
            store.save(run_id, raw, good)
            store.note(run_id, "completed", config, raw.count(), good.count())
        return PipelineResult(raw, good, shaped, warnings, run_id)
    except Exception:
        if store:
            store.note(run_id, "failed", config)
        raise
