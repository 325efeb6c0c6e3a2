"""Raw records of each type of source, in one shape: source_pos, row_pos, source_id, source_type, raw_confidence, fields."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.scalars import slug_name
from kindred.operators import resume
from kindred.operators.normalize import hint
from kindred.plans.tables import kept

JOBS = "array<struct<company:string,title:string,start:string,end:string,summary:string>>"
SCHOOLS = "array<struct<institution:string,degree:string,field:string,end_year:string>>"
#: All members that any source has; what a source lacks is null.
FIELDS = {
    "name": "string", "email": "string", "emails": "array<string>", "phone": "string", "phones": "array<string>", "current_company": "string", "title": "string",
    "years_experience": "double", "linkedin": "string", "github": "string", "portfolio": "string", "other_links": "array<string>", "headline": "string", "bio": "string",
    "languages": "array<string>", "skills": "array<string>", "public_repos": "int", "city": "string", "region": "string", "country": "string",
    "location": "struct<city:string,region:string,country:string>", "experience": JOBS, "education": SCHOOLS, "links": "struct<linkedin:string,github:string,portfolio:string,other:array<string>>",
}


def record(confidence: Column, **members: Column) -> Column:
    """struct<raw_confidence, fields> with the members that are told."""
    own = [members[n].cast(kind).alias(n) if n in members else F.lit(None).cast(kind).alias(n) for n, kind in FIELDS.items()]
    return F.struct(confidence.cast("double").alias("raw_confidence"), F.struct(*own).alias("fields"))


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def _numeric(body: Column, path: str) -> Column:
    """A number that is written as one; a text of digits is none."""
    plain = F.try_variant_get(F.try_parse_json(body), path, "double")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), path, "variant"))
    return F.when(kind != "STRING", plain)


def _readable(body: Column, *lists: str) -> Column:
    """Whether a text is JSON and the lists in it have no null among their members."""
    told = F.try_parse_json(body)
    holes = [F.exists(F.try_variant_get(told, f"$.{n}", "array<variant>"), lambda x: x.isNull() | F.is_variant_null(x)) for n in lists]
    return told.isNotNull() & ~F.coalesce(*[F.when(h, True) for h in holes], F.lit(False))


def ats_record(body: Column) -> Column:
    """A record of an applicant system's JSON; confidence 0 and no members if it can't be parsed or a job or school in it is null."""
    jobs = T._parse_datatype_string("array<struct<firm:string,role:string,from:string,to:string,desc:string>>")
    schools = T._parse_datatype_string("array<struct<univ:string,dip:string,major:string,grad_yr:string>>")
    get = lambda name: _some(F.get_json_object(body, f"$.{name}"))
    whole = _readable(body, "jobs", "schools")
    only = lambda c: F.when(whole, c)
    job = F.transform(F.from_json(F.get_json_object(body, "$.jobs"), jobs), lambda j: F.struct(j["firm"].alias("company"), j["role"].alias("title"), j["from"].alias("start"), j["to"].alias("end"), j["desc"].alias("summary")))
    school = F.transform(F.from_json(F.get_json_object(body, "$.schools"), schools), lambda s: F.struct(s["univ"].alias("institution"), s["dip"].alias("degree"), s["major"].alias("field"), F.when(s["grad_yr"].rlike(_NUMBER), s["grad_yr"].try_cast("int")).alias("end_year")))
    return record(
        F.when(whole, 0.95).otherwise(0.0), name=only(get("cand_full_name")), email=only(get("email_addr")), phone=only(get("phone_num")), current_company=only(get("company_name")), title=only(get("position")),
        years_experience=only(_numeric(body, "$.years_of_experience")), linkedin=only(get("linkedin_url")), github=only(get("github_url")), experience=only(job), education=only(school),
    )


def linkedin_record(body: Column) -> Column:
    """A record of a LinkedIn profile's JSON; emails and phones are lists or single. Confidence 0 and no members as for `ats_record`."""
    get = lambda name: _some(F.get_json_object(body, f"$.{name}"))
    whole = _readable(body, "experience", "education")
    only = lambda c: F.when(whole, c)
    many = lambda name: F.from_json(F.get_json_object(body, f"$.{name}"), T.ArrayType(T.StringType()))
    listed = lambda names, one: F.coalesce(F.when(F.get_json_object(body, f"$.{names}").startswith("["), many(names)), F.when(get(one).isNotNull(), F.array(get(one))))
    parsed = lambda name, kind: F.from_json(F.get_json_object(body, f"$.{name}"), T._parse_datatype_string(kind))
    return record(
        F.when(whole, 0.9).otherwise(0.0), name=only(get("name")), headline=only(get("headline")), emails=only(listed("emails", "email")), phones=only(listed("phones", "phone")), linkedin=only(get("linkedin")),
        github=only(get("github")), portfolio=only(get("portfolio")), experience=only(parsed("experience", JOBS)), education=only(parsed("education", SCHOOLS)),
    )


def slug_record(url: Column) -> Column:
    """A record of a profile's link alone: a name from its slug, confidence 0.3; none without a slug."""
    slug = F.regexp_extract(url, r"(?i)linkedin\.com/in/([^/?#\s]+)", 1)
    there = slug != ""
    return record(F.when(there, 0.3).otherwise(0.0), name=F.when(there, slug_name(slug)), linkedin=F.when(there, url))


def csv_record(row: Column) -> Column:
    """A record of a row with the columns name, email, phone, current_company, title."""
    return record(F.lit(0.9), **{n: _some(row[n]) for n in ("name", "email", "phone", "current_company", "title")})


def resume_record(text: Column, confidence: float) -> Column:
    f = resume.fields(text)
    there = F.coalesce(F.length(text) > 0, F.lit(False))
    members = {n: F.when(there, f[n]) for n in ("name", "emails", "phones", "links", "skills", "experience", "education")}
    return record(F.when(there, confidence).otherwise(0.0), **members)


def languages(repos: DataFrame) -> DataFrame:
    """(user, languages) of repositories (user, pos, language): the most used first, then the first seen."""
    counted = repos.where("language is not null and language != ''").groupBy("user", "language").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rows = counted.groupBy("user").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "language"))).alias("rows"))
    return rows.select("user", F.transform("rows", lambda r: r["language"]).alias("languages"))


def github_records(users: DataFrame, repos: DataFrame) -> DataFrame:
    """Profiles (user, name, email, bio, html_url, blog, public_repos) with their languages as raw records; source_id is github:<user>."""
    rows = users.join(languages(repos), "user", "left")
    page = F.coalesce(_some(F.col("html_url")), F.concat(F.lit("https://github.com/"), F.col("user")))
    told = record(F.lit(0.8), name=_some(F.col("name")), email=_some(F.col("email")), bio=_some(F.col("bio")), github=page, portfolio=_some(F.col("blog")), public_repos=F.coalesce("public_repos", F.lit(0)), languages=F.coalesce("languages", F.array().cast("array<string>")))
    return rows.select(F.concat(F.lit("github:"), "user").alias("source_id"), F.lit("github_api").alias("source_type"), told.alias("r")).select("source_id", "source_type", "r.*")


#: A cell and a record of CSV with the delimiter D: a quoted cell may hold delimiters, line feeds and doubled quotes.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"[^D\r\n]*+|[^D\r\n]*+)'
_RECORD = rf"{_CELL}(?:D{_CELL})*+(?:\r\n|\n|\r|\z)"
#: A cell with the delimiter before it.
_EACH = f"D{_CELL}"
#: What can delimit cells, in the order that decides between equals, and from how many records and lines of a file it is guessed.
DELIMITERS, GUESSED, HEAD_LINES = (",", "\t", "|", ";"), 10, 1000
#: The rest of a line that ends within a quoted cell: a cell that is closed, and text within quotes.
_CLOSED, _WITHIN = r'(?:"[^"]*+(?:""[^"]*+)*+"[^D\r]*+|(?!")[^D\r]*+)', r'[^"]*+(?:""[^"]*+)*+'
_OPENS = rf'\A(?:{_CLOSED}[D\r])*+"{_WITHIN}\z'
_STAYS_OPEN = rf'\A{_WITHIN}(?:"[^D\r]*+(?:[D\r]{_CLOSED})*+[D\r]"{_WITHIN})?+\z'
COLUMNS = ("name", "email", "phone", "current_company", "title")


def _by(pattern: str, mark: Column | str) -> Column:
    """The pattern with the delimiter in its place."""
    return F.replace(F.lit(pattern), F.lit("D"), F.concat(F.lit("\\"), F.lit(mark) if isinstance(mark, str) else mark))


def _records(text: Column, mark: Column | str) -> Column:
    """The records of a text; empty lines are none."""
    return F.filter(F.transform(F.regexp_extract_all(text, _by(_RECORD, mark), F.lit(0)), lambda r: F.regexp_replace(r, r"[\r\n]+$", "")), lambda r: ~r.isin("", '""'))


def _cells(record: Column, mark: Column | str) -> Column:
    quoted = lambda c: F.when(c.startswith('"') & (F.length(c) > 1), F.regexp_replace(F.regexp_replace(c, r'(?s)^"(.*)"[^"]*$', "$1"), '""', '"')).otherwise(c)
    return F.transform(F.regexp_extract_all(F.concat(F.lit(mark) if isinstance(mark, str) else mark, record), _by(_EACH, mark), F.lit(0)), lambda c: quoted(F.substr(c, F.lit(2))))


def _cut(head: Column, mark: str) -> Column:
    """struct<uneven, mean, mark>: by how many cells the first records differ from the ones before, and how many they have."""
    many = F.transform(F.slice(_records(head, mark), 1, GUESSED), lambda r: F.size(_cells(r, mark)))
    state = lambda last, uneven, total, n: F.struct(last.alias("last"), uneven.alias("uneven"), total.alias("total"), n.alias("n"))
    step = lambda s, x: state(x, s["uneven"] + F.when(s["n"] > 0, F.abs(x - s["last"])).otherwise(0), s["total"] + x, s["n"] + 1)
    told = lambda s: F.struct(s["uneven"].alias("uneven"), F.when(s["n"] > 0, s["total"] / s["n"]).otherwise(0.0).alias("mean"), F.lit(mark).alias("mark"))
    return F.aggregate(many, state(F.lit(0), F.lit(0), F.lit(0), F.lit(0)), step, told)


def delimiter(text: Column) -> Column:
    """Which of DELIMITERS cuts the first records of a text most evenly; of those the one that gives most cells. None that gives two or more: a comma."""
    head = F.substring_index(text, "\n", HEAD_LINES)
    start = F.struct(F.lit(1 << 30).alias("uneven"), F.lit(1.99).alias("mean"), F.lit(DELIMITERS[0]).alias("mark"))
    better = lambda best, x: F.when((x["uneven"] <= best["uneven"]) & (x["mean"] > best["mean"]), x).otherwise(best)
    return F.aggregate(F.array(*[_cut(head, mark) for mark in DELIMITERS]), start, better)["mark"]


def _csv_records(rows: DataFrame) -> DataFrame:
    """Raw records of (source_pos, source_id, mark, head, row_pos, record). The first column of a name counts; a short row lacks its last cells."""
    rows = rows.withColumn("cells", _cells(F.col("record"), F.col("mark")))
    rows = rows.withColumn("row", F.struct(*[F.get("cells", (F.array_position("head", n) - 1).cast("int")).alias(n) for n in COLUMNS]))
    return rows.select("source_pos", F.col("row_pos").cast("int").alias("row_pos"), F.concat("source_id", F.lit("#row"), F.col("row_pos").cast("string")).alias("source_id"), F.lit("recruiter_csv").alias("source_type"), csv_record(F.col("row")).alias("r"))


def csv_rows(sources: DataFrame) -> DataFrame:
    """A row for each record of CSV sources (source_pos, source_id, text): the first record names the columns, of which the first of a name counts.

    Quoted cells may hold delimiters, line feeds and doubled quotes. Empty lines are no records; a short row lacks its last cells,
    and cells beyond the header are left out. A text is one task's; `csv_line_rows` reads files by lines.
    """
    text = F.regexp_replace("text", "^﻿", "")
    rows = sources.select("source_pos", "source_id", text.alias("text"), delimiter(text).alias("mark"))
    rows = rows.withColumn("records", _records(F.col("text"), F.col("mark"))).where(F.size("records") > 1)
    # The head is worked out before, or each row would carry all records until it takes the head from them.
    rows = rows.select("source_pos", "source_id", "mark", _cells(F.col("records")[0], F.col("mark")).alias("head"), F.slice("records", 2, 1_000_000_000).alias("records"))
    return _csv_records(rows.select("source_pos", "source_id", "mark", "head", F.posexplode("records").alias("row_pos", "record")))


def csv_line_rows(lines: DataFrame) -> DataFrame:
    """As csv_rows, from the lines of files: (source_pos, source_id, range, line, value), ranges of a file and lines of a range by their order.

    Whether a line begins within a quoted cell depends on all lines before it, so each line tells in advance how it ends in either
    case: a line with the same end in both settles it, others keep or turn it. What a range does to it is one row; ranges are put
    together by a window over these, lines by one over their range. Lines that make up a record are joined, other lines are records
    as they are; rows are numbered by the ranges' counts. A quoted cell that isn't closed at all is read as one text to the file's end.
    """
    file, at = ["source_pos"], ["source_pos", "range"]
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = lines.where("range = 0").withColumn("place", F.row_number().over(Window.partitionBy("source_pos").orderBy("line"))).where(F.col("place") <= HEAD_LINES)
    heads = first.groupBy(*file).agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("head"))
    heads = kept(heads.select("source_pos", delimiter(F.regexp_replace(F.array_join(F.transform("head", lambda x: x["value"]), "\n"), "^﻿", "")).alias("mark")), "heads")
    rows = lines.join(heads, "source_pos").withColumn("value", F.when((F.col("range") == 0) & F.col("value").startswith("﻿") & (F.col("line") == F.min("line").over(Window.partitionBy(*at))), F.substr("value", F.lit(2))).otherwise(F.col("value")))
    ends = lambda pattern: F.regexp_like("value", _by(pattern, F.col("mark")))
    rows = kept(rows.withColumn("open0", ends(_OPENS)).withColumn("open1", ends(_STAYS_OPEN)), "ends")
    # Ends that differ as the beginnings do keep it, ends that differ otherwise turn it, equal ends settle it.
    turns = F.when(F.col("open0") & ~F.col("open1"), 1).otherwise(0)
    rows = rows.withColumn("turned", F.coalesce(F.sum(turns).over(before(at, "line")), F.lit(0)))
    settles = F.when(F.col("open0") == F.col("open1"), F.struct(F.col("open0").cast("int").alias("open"), F.col("turned").alias("then")))
    rows = rows.withColumn("settled", F.last(settles, True).over(before(at, "line")))
    here = lambda settled, turned: F.when(settled.isNotNull(), (settled["open"] + turned - settled["then"]) % 2)
    ranges = rows.groupBy(*at).agg(F.max_by(settles, F.when(settles.isNotNull(), F.col("line"))).alias("settled"), F.sum(turns).alias("turns"))
    ranges = ranges.withColumn("open", here(F.col("settled"), F.col("turns"))).withColumn("turned", F.coalesce(F.sum("turns").over(before(file, "range")), F.lit(0)))
    last = F.last(F.when(F.col("open").isNotNull(), F.struct("open", (F.col("turned") + F.col("turns")).alias("then"))), True).over(before(file, "range"))
    ranges = ranges.withColumn("last", last).select(*at, F.coalesce((F.col("last.open") + F.col("turned") - F.col("last.then")) % 2, F.col("turned") % 2).alias("begins"))
    rows = rows.join(ranges, at).withColumn("begins", F.coalesce(here(F.col("settled"), F.col("turned")), (F.col("begins") + F.col("turned")) % 2))
    rows = rows.withColumn("ends", F.when(F.col("begins") == 1, F.col("open1")).otherwise(F.col("open0")))
    alone = rows.where("begins = 0 and not ends").select(*at, "line", "source_id", "mark", F.col("value").alias("text"))
    # The pieces of a record go by the place where it begins.
    parts = rows.where("begins = 1 or ends").withColumn("start", F.when(F.col("begins") == 0, F.struct("range", "line")))
    opened = parts.groupBy(*at).agg(F.max("start").alias("opened")).withColumn("opened", F.last("opened", True).over(before(file, "range")))
    own = F.last("start", True).over(Window.partitionBy(*at).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("start", own).join(opened, at).withColumn("start", F.coalesce("start", "opened"))
    joined = parts.groupBy("source_pos", "source_id", "mark", "start").agg(F.array_sort(F.collect_list(F.struct("range", "line", "value"))).alias("lines"))
    joined = joined.select("source_pos", F.col("start.range").alias("range"), F.col("start.line").alias("line"), "source_id", "mark", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("text"))
    told = alone.unionByName(joined).withColumn("records", _records(F.col("text"), F.col("mark"))).withColumn("n", F.size("records"))
    told = kept(told.where("n > 0").drop("text"), "records")
    starts = told.groupBy(*at).agg(F.sum("n").alias("held")).withColumn("start", F.coalesce(F.sum("held").over(before(file, "range")), F.lit(0))).select(*at, "start")
    told = told.withColumn("number", F.coalesce(F.sum("n").over(before(at, "line")), F.lit(0))).join(starts, at).withColumn("number", F.col("number") + F.col("start"))
    told = told.select("source_pos", "source_id", "mark", "number", F.posexplode("records").alias("k", "record")).withColumn("number", F.col("number") + F.col("k")).drop("k")
    head = told.where("number = 0").select("source_pos", _cells(F.col("record"), F.col("mark")).alias("head"))
    return _csv_records(told.where("number > 0").join(head, "source_pos").withColumn("row_pos", F.col("number") - 1))


def _whole(make: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda s: s.select("source_pos", F.lit(0).alias("row_pos"), "source_id", "source_type", make(F.col("text")).alias("r"))


def _linkedin(s: DataFrame) -> DataFrame:
    """By its JSON; without content by its link."""
    body, link = F.col("text"), F.coalesce(_some(F.trim("text")), F.col("url"))
    by_link = link.rlike(r"(?i)^(https?://)?(www\.)?linkedin\.com/")
    return s.select("source_pos", F.lit(0).alias("row_pos"), "source_id", "source_type", F.when(by_link, slug_record(link)).otherwise(linkedin_record(body)).alias("r"))


def with_fixtures(sources: DataFrame, fixtures: DataFrame) -> DataFrame:
    """sources whose LinkedIn link has a stored profile (slug, body) get that as their text; Spark picks the join by the fixtures' size."""
    slug = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.col("text")), r"(?i)linkedin\.com/in/([^/?#\s]+)", 1))
    own = fixtures.select(F.lower("slug").alias("__slug"), F.col("body").alias("__body")).dropDuplicates(["__slug"])
    rows = sources.join(own, (slug == F.col("__slug")) & (F.col("source_type") == "linkedin_json"), "left")
    found = F.col("__body").isNotNull()
    return rows.withColumn("text", F.when(found, F.col("__body")).otherwise(F.col("text"))).withColumn("url", F.when(~found, F.col("url"))).drop("__slug", "__body")


def github_user(url: Column, text: Column) -> Column:
    """The user of a GitHub link, or the text itself."""
    link = F.trim(F.coalesce(_some(url), text, F.lit("")))
    return F.when(link.contains("github.com"), F.regexp_extract(link, r"github\.com/+([^/?#\s]+)", 1)).otherwise(link)


def _github(s: DataFrame) -> DataFrame:
    """By the fetched profile in the column `profile`, if there is one; else a record without members and confidence 0."""
    user = github_user(F.col("url"), F.col("text"))
    name = F.when(user == "", F.col("source_id")).otherwise(F.concat(F.lit("github:"), user))
    told = F.col("profile") if "profile" in s.columns else record(F.lit(0.0))
    return s.select("source_pos", F.lit(0).alias("row_pos"), name.alias("source_id"), "source_type", F.coalesce(told, record(F.lit(0.0))).alias("r"))


def with_profiles(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """sources whose GitHub link has a fetched profile (user, name, email, bio, html_url, blog, public_repos, languages) get its record as `profile`."""
    page = F.coalesce(_some(F.col("html_url")), F.concat(F.lit("https://github.com/"), F.col("user")))
    told = record(F.lit(0.8), name=_some(F.col("name")), email=_some(F.col("email")), bio=_some(F.col("bio")), github=page, portfolio=_some(F.col("blog")), public_repos=F.coalesce("public_repos", F.lit(0)), languages=F.coalesce("languages", F.array().cast("array<string>")))
    own = profiles.where("not failed" if "failed" in profiles.columns else "true").select(F.col("user").alias("__user"), told.alias("profile")).dropDuplicates(["__user"])
    same = (F.col("source_type") == "github_api") & (github_user(F.col("url"), F.col("text")) == F.col("__user"))
    return sources.join(own, same, "left").drop("__user")


#: Extractors by source type; add one to read another type. Binary documents come as text: see kindred.sources.documents.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "recruiter_csv": csv_rows, "github_api": _github, "ats_json": _whole(ats_record), "linkedin_json": _linkedin, "resume_pdf": _whole(lambda t: resume_record(t, 0.7)),
    "resume_docx": _whole(lambda t: resume_record(t, 0.7)), "recruiter_notes": _whole(lambda t: resume_record(t, 0.3)),
}


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of an extractor with rec_ord, and who they may be of."""
    order = F.col("source_pos").cast("long") * (1 << 32) + F.col("row_pos")
    f = F.col("r.fields")
    single = lambda many, one: F.coalesce(F.when(F.size(many) > 0, many), F.array(one))
    seen = hint(f["name"], single(f["emails"], f["email"]), single(f["phones"], f["phone"]))
    return rows.select(order.alias("rec_ord"), "source_pos", "row_pos", "source_id", "source_type", "r.raw_confidence", seen.alias("candidate_hint"), "r.fields")


def raw_parts(sources: DataFrame, csv: DataFrame | None = None, kinds: Iterable[str] = EXTRACTORS) -> list[DataFrame]:
    """What `raw_records` unites: the records of CSV files, and of the sources of each kind."""
    parts = [csv_line_rows(csv)] if csv is not None else []
    return [_ordered(p) for p in (*parts, *(EXTRACTORS[kind](sources.where(F.col("source_type") == kind)) for kind in kinds))]


def raw_records(sources: DataFrame, csv: DataFrame | None = None) -> DataFrame:
    """Raw records of typed sources (source_pos, source_id, source_type, url, text) and the lines of CSV files, ordered by rec_ord."""
    return reduce(DataFrame.unionByName, raw_parts(sources, csv))


