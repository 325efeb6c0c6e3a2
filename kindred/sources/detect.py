"""The type of a source by its link, its file name's ending, or what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("recruiter_csv", "ats_json", "github_api", "linkedin_json", "resume_pdf", "resume_docx", "recruiter_notes")
_ATS, _LINKEDIN = ("cand_full_name", "email_addr", "phone_num"), ("headline", "linkedin", "education")
#: Of these members so many decide for content without a file name's ending.
_SNIFFED = 2


def _truthy(body: Column, names: tuple[str, ...]) -> Column:
    """Whether any of the members holds something other than null, false, 0 or an empty text. The text "0" is something."""
    out, told = F.lit(False), F.try_parse_json(body)
    for n in names:
        v = F.get_json_object(body, f"$.{n}")
        text = F.coalesce(F.schema_of_variant(F.try_variant_get(told, f"$.{n}", "variant")) == "STRING", F.lit(False))
        out = out | F.coalesce((v != "") & (text | ~v.isin("0", "false", "null", "0.0")), F.lit(False))
    return out


def source_type(content: Column, filename: Column, url: Column) -> Column:
    """One of TYPES. content: the source as text."""
    link = F.lower(F.coalesce(url, F.lit("")))
    ending = F.lower(F.element_at(F.split(F.coalesce(filename, F.lit("")), r"\."), -1))
    text = F.coalesce(content, F.lit(""))
    shape = F.when(_truthy(text, _ATS), "ats_json").when(_truthy(text, _LINKEDIN), "linkedin_json").otherwise("ats_json")
    bare = F.ltrim(text)
    sniffed = F.when(_truthy(text, _ATS[:_SNIFFED]), "ats_json").when(_truthy(text, _LINKEDIN[:_SNIFFED]), "linkedin_json")
    return (
        F.when(link.contains("github.com"), "github_api").when(link.contains("linkedin.com"), "linkedin_json")
        .when(ending == "csv", "recruiter_csv").when(ending == "pdf", "resume_pdf").when(ending == "docx", "resume_docx").when(ending == "txt", "recruiter_notes")
        .when(ending == "json", shape)
        .when(bare.startswith("{") & sniffed.isNotNull(), sniffed)
        .when(F.lower(text).contains("name,email,phone"), "recruiter_csv")
        .otherwise("recruiter_notes")
    )


def detect_sources(sources: DataFrame) -> DataFrame:
    """sources (source_pos, filename, url, content: binary) with source_id, source_type and the content as text.

    Bytes that aren't UTF-8 become U+FFFD, so a file in another encoding, or a PDF, is typed like any other.
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    name = F.coalesce(F.nullif("filename", F.lit("")), F.nullif("url", F.lit("")), F.concat(F.lit("source_"), F.col("source_pos").cast("string")))
    return sources.withColumn("text", text).withColumn("source_id", name).withColumn("source_type", source_type(F.col("text"), F.col("filename"), F.col("url")))
