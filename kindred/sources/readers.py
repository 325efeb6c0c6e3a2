"""Files, inline lists and links as sources: (source_pos, filename, url, content)."""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterable, Iterator
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kindred.operators.extract import github_user
from kindred.plans.tables import kept

SCHEMA = "source_pos int, filename string, url string, content binary"
EXTENSIONS = ("csv", "json", "pdf", "docx", "txt")


def _stored(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder, or the file itself, in a store that Hadoop's file systems reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isFile()) if fs.exists(path) else []


def resolve_paths(paths: str, spark: SparkSession | None = None) -> tuple[list[str], list[str]]:
    """Files of a comma-separated list of files, folders (not deeper) and patterns in the last part, and warnings of what isn't there.

    Paths with a scheme are looked up by `spark`, in whatever store they name.
    """
    found, warnings = [], []
    for p in filter(None, map(str.strip, paths.split(","))):
        folder, last = os.path.split(p)
        if "://" in p and spark is not None:
            rule = re.compile(fnmatch.translate(last.replace("[", "[[]").replace("?", "[?]")), re.IGNORECASE)
            own = [x for x in _stored(spark, folder) if rule.match(x.rsplit("/", 1)[-1])] if "*" in last else _stored(spark, p)
        elif "*" in last:
            rule = re.compile(fnmatch.translate(last.replace("[", "[[]").replace("?", "[?]")), re.IGNORECASE)
            names = sorted(os.listdir(folder or ".")) if os.path.isdir(folder or ".") else []
            own = [os.path.join(folder, n) for n in names if rule.match(n) and os.path.isfile(os.path.join(folder, n))]
        elif os.path.isdir(p):
            own = [os.path.join(p, n) for n in sorted(os.listdir(p)) if os.path.isfile(os.path.join(p, n))]
        else:
            own = [p] if os.path.isfile(p) else []
        if not own:
            warnings.append(f"Path not found: {p}")
        found += own
    return list(dict.fromkeys(found)), warnings


def _literal(path: str) -> str:
    """A pattern that the file matches; what else it may match is left out by its path."""
    return re.sub(r"[\[\]{}*?\\]", "?", path)


def _ordered(spark: SparkSession, paths: list[str], first: int, csv: bool | None) -> DataFrame:
    """(source_pos, at) of paths, with csv only of CSV files, with False only of others."""
    plain = [(first + k, re.sub("^file:/*", "/", p) if ":/" in p else os.path.abspath(p)) for k, p in enumerate(paths) if csv is None or _is_csv(p) == csv]
    return spark.createDataFrame(plain, "source_pos int, at string")


def _is_csv(path: str) -> bool:
    return path.lower().endswith(".csv")


def _place(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def file_sources(spark: SparkSession, paths: list[str], first: int = 0, csv: bool = True) -> DataFrame:
    """Sources of files, in the order of the list; the content is read by tasks. A path may be of any store that Spark reads.

    Without `csv`, CSV files are left out: csv_lines reads them.
    """
    order = _ordered(spark, paths, first, None if csv else False)
    paths = [p for p in paths if csv or not _is_csv(p)]
    files = spark.read.format("binaryFile").load(list(map(_literal, paths))).select(_place(F.col("path")).alias("at"), "content") if paths else spark.createDataFrame([], "at string, content binary")
    return order.join(files, "at").select("source_pos", F.element_at(F.split("at", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("url"), "content")


def csv_lines(spark: SparkSession, paths: list[str], first: int = 0) -> DataFrame | None:
    """The lines of the CSV files among paths, for `csv_line_rows`, in ranges as Spark splits files; written once, so that lines keep their numbers. None without such files."""
    own = [p for p in paths if _is_csv(p)]
    if not own:
        return None
    files = spark.read.option("lineSep", "\n").text(list(map(_literal, own)))
    url = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = files.select(_place(url).alias("at"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("line"), F.make_valid_utf8("value").alias("value"))
    lines = kept(lines.join(F.broadcast(_ordered(spark, paths, first, True)), "at"), "lines")  # the list of paths was the caller's
    return lines.select("source_pos", F.element_at(F.split("at", "/"), -1).alias("source_id"), "range", "line", "value")


def folder_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of all files below a folder with a known ending, at any scale, in the order of their paths."""
    return numbered(spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,json,pdf,docx,txt}").option("recursiveFileLookup", True).load(folder))


def numbered(files: DataFrame) -> DataFrame:
    """Sources of files (path, content), numbered from 0 by their paths: each range of paths is numbered by its own task, after those before it."""
    ranges = files.select("path").repartitionByRange("path").sortWithinPartitions("path").select("path", F.spark_partition_id().alias("part"))
    ranges = kept(ranges.withColumn("at", F.monotonically_increasing_id() % (1 << 33)), "paths")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    start = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = ranges.join(start, "part").select("path", (F.col("start") + F.col("at")).cast("int").alias("source_pos"))
    return files.select("path", "content").join(place, "path").select("source_pos", F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("url"), "content")


def stored_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, body) of the files linkedin_<slug>.json of a folder."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "linkedin_*.json").text(folder)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^linkedin_(.*)\.json$", 1).alias("slug"), F.col("value").alias("body"))


def inline_sources(spark: SparkSession, items: Iterable[dict], first: int = 0) -> DataFrame:
    """Sources of dicts with filename, url, content (text, bytes or none)."""
    rows = [(first + k, s.get("filename"), s.get("url"), c.encode() if isinstance(c := s.get("content"), str) else c) for k, s in enumerate(items)]
    return spark.createDataFrame(rows, SCHEMA)


def link_sources(spark: SparkSession, github: str | None = None, linkedin: str | None = None, first: int = 0) -> DataFrame:
    """Sources of profile links; the link is their content."""
    pairs = [(n, u) for n, u in (("github_api", github), ("linkedin_json", linkedin)) if u]
    return spark.createDataFrame([(first + k, n, u, u.encode()) for k, (n, u) in enumerate(pairs)], SCHEMA)


PROFILE = "user string, name string, email string, bio string, html_url string, blog string, public_repos int, languages array<string>, failed boolean"
GITHUB, PAGE = "https://api.github.com/users", 100


def fetched(user: str, base: str = GITHUB, pages: int = 1) -> tuple:
    """A user's profile and the languages of the repositories on the first pages; a user that can't be fetched comes without members.

    base may be a file: URL of a folder with <user>.json, <user>.repos.json and, for further pages, <user>.repos.<page>.json.
    """
    local = base.startswith("file:")

    def load(url: str) -> object:
        with urlopen(url, timeout=30) as f:
            return json.load(f)

    try:
        told = load(f"{base}/{user}.json" if local else f"{base}/{user}")
    except (OSError, ValueError):
        return (user, None, None, None, None, None, None, [], True)
    repos = []
    try:
        for page in range(1, pages + 1):
            own = load(f"{base}/{user}.repos{'' if page == 1 else f'.{page}'}.json" if local else f"{base}/{user}/repos?per_page={PAGE}&page={page}")
            repos += [r["language"] for r in own if r.get("language")]
            if len(own) < PAGE:
                break
    except (OSError, ValueError):
        pass
    by = sorted(dict.fromkeys(repos), key=lambda x: (-repos.count(x), repos.index(x)))
    return (user, told.get("name"), told.get("email"), told.get("bio"), told.get("html_url"), told.get("blog"), told.get("public_repos") or 0, by, False)


def fetched_profiles(sources: DataFrame, base: str = GITHUB, pages: int = 1, tasks: int = 8) -> DataFrame:
    """The profiles of all users that sources (url, content) link to, each fetched once, by `tasks` tasks; no list passes through the driver."""
    text = F.col("content").cast("string")
    link = F.lower(F.coalesce("url", text)).contains("github.com")
    users = sources.where(link).select(github_user(F.col("url"), text).alias("user")).where("user != ''").distinct().repartition(tasks, "user")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fetched(u, base, pages) for u in batch.column(0).to_pylist()]
            kinds = [pa.string()] * 6 + [pa.int32(), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in PROFILE.split(", ")])

    return users.mapInArrow(run, PROFILE)


class _Page(InputPartition):
    def __init__(self, users: list[str]):
        self.users = users


class GithubProfiles(DataSource):
    """Profiles of named users: spark.read.format("github_profiles").options(users="a,b", base=URL, pages=1), some users a task.

    For the users that sources link to see fetched_profiles.
    """

    @classmethod
    def name(cls) -> str:
        return "github_profiles"

    def schema(self) -> str:
        return PROFILE

    def reader(self, schema) -> DataSourceReader:
        return _GithubReader(self.options)


class _GithubReader(DataSourceReader):
    def __init__(self, options):
        self.users = [u for u in options.get("users", "").split(",") if u]
        self.base, self.pages = options.get("base", GITHUB), int(options.get("pages", "1"))

    def partitions(self):
        tasks = min(8, len(self.users))
        return [_Page(self.users[k::tasks]) for k in range(tasks)]

    def read(self, partition) -> Iterator[tuple]:
        for user in partition.users:
            yield fetched(user, self.base, self.pages)


def documents_text(content: pa.Array, kind: pa.Array) -> pa.Array:
    from kindred.sources import documents

    return pa.array([documents.text_of(c.as_py(), k.as_py()) for c, k in zip(content, kind, strict=True)], pa.string())
