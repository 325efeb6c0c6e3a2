"""Whole runs over bytes as they come: documents, odd encodings, links, folders and streams."""

import csv
import io
import json
import random
import zipfile
import zlib

from pyspark.sql import functions as F

from kindred.__main__ import main
from kindred.operators import extract
from kindred.plans.config import parse_config
from kindred.plans.pipeline import run_pipeline
from kindred.plans.project import as_json, projected
from kindred.plans.store import Store
from kindred.sources import detect, readers
from kindred.streaming.ingest import watch

RESUME = "Mira Okafor\nmira.okafor@mail.test\n212-555-0147\n\nEXPERIENCE\nData Engineer - Lumen Labs | Mar 2019 - Apr 2021\n- Moved tables\n"


def pdf(text):
    """A PDF as tools write it: a comment of high bytes, a deflated page stream."""
    shown = " ".join(f"({line}) Tj T*" for line in text.replace("(", "\\(").replace(")", "\\)").split("\n"))
    page = zlib.compress(f"BT {shown} ET".encode("latin-1"))
    return b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n1 0 obj\n<</Length " + str(len(page)).encode() + b"/Filter/FlateDecode>>\nstream\n" + page + b"\nendstream\nendobj\n%%EOF"


def docx(text):
    buffer = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        rows = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in text.split("\n"))
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{rows}</w:body></w:document>')
    return buffer.getvalue()


def test_every_kind_of_file(spark, tmp_path):
    (tmp_path / "okafor.json").write_text(json.dumps({"name": "Ode Okafor", "email": "ode@mail.test", "public_repos": 2}))
    spark.dataSource.register(readers.GithubProfiles)
    github = spark.read.format("github_profiles").options(users="okafor,nobody", base=f"file://{tmp_path}").load()
    linkedin = spark.createDataFrame([("tomas-lind", json.dumps({"name": "Tomas Lind", "emails": ["tomas@mail.test"]}))], "slug string, body string")
    sources = readers.inline_sources(spark, [
        {"filename": "mira.pdf", "content": pdf(RESUME)}, {"filename": "mira.docx", "content": docx(RESUME)}, {"filename": "note.txt", "content": "Renée Dubois\nrenee@mail.test".encode("latin-1")},
        {"filename": "github_api", "url": "https://github.com/okafor", "content": "https://github.com/okafor"}, {"url": "https://github.com/nobody?tab=x", "content": None},
        {"url": "https://www.linkedin.com/in/Tomas-Lind/", "content": "https://www.linkedin.com/in/Tomas-Lind/"}, {"filename": "broken.pdf", "content": b"\x00\xff\xfe"},
    ])
    result = run_pipeline(spark, sources, github=github, linkedin=linkedin)
    raw = {r.source_pos: r for r in result.raw.collect()}
    assert raw.keys() == set(range(7))
    assert raw[0].fields.emails == raw[1].fields.emails == ["mira.okafor@mail.test"] and raw[0].raw_confidence == 0.7
    assert raw[2].fields.emails == ["renee@mail.test"]
    assert (raw[3].source_id, raw[3].raw_confidence, raw[3].fields.name, raw[3].fields.github) == ("github:okafor", 0.8, "Ode Okafor", "https://github.com/okafor")
    assert (raw[4].source_id, raw[4].raw_confidence) == ("github:nobody", 0.0)
    assert raw[5].fields.name == "Tomas Lind" and raw[6].raw_confidence == 0.0
    assert {r.subject for r in result.warnings.where("stage = 'extract'").collect()} == {"github:nobody", "broken.pdf"}
    assert sorted(r.full_name for r in result.projected.collect() if r.emails)[0] == "Mira Okafor"


def test_sniffing(spark):
    told = [({"cand_full_name": "a"}, "ats_json"), ({"phone_num": "1"}, "recruiter_notes"), ({"education": ["x"]}, "recruiter_notes"), ({"headline": "x"}, "linkedin_json"), ({"email_addr": 0}, "recruiter_notes"), ({"email_addr": "0"}, "ats_json")]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, (x, _) in enumerate(told)], "k int, text string")
    none = F.lit(None).cast("string")
    got = {r.k: r.t for r in df.select("k", detect.source_type(F.col("text"), none, none).alias("t")).collect()}
    assert [got[k] for k in range(len(told))] == [t for _, t in told]


def test_csv_rows(spark):
    """Against Python's reader: quotes, line feeds in cells, repeated, wide and short rows, other delimiters."""
    rng = random.Random(7)
    names, texts, want = ["name", "email", "phone", "current_company", "title"], [], {}
    for k in range(40):
        mark = rng.choice(",;\t|")
        head = rng.sample(names, rng.randrange(2, 6)) + ["note"] * rng.randrange(3) + [f"x{i}" for i in range(rng.choice([0, 0, 150]))]
        rows = [["".join(rng.choice(['a', 'B c', '""', '"', "\n", mark, "é", "'"]) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, len(head) + 2))] for _ in range(rng.randrange(4))]
        buffer = io.StringIO()
        writer = csv.writer(buffer, delimiter=mark, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
        writer.writerows([head, *rows])
        text = ("\ufeff" if k % 5 == 0 else "") + buffer.getvalue() + "\n" * (k % 3)
        texts.append((k, f"s{k}", text))
        lines = [r for r in rows if r != [""]]
        for n, row in enumerate(lines):
            by = {}
            for h, cell in zip(head, row, strict=False):
                by.setdefault(h, cell.replace("\r\n", "\n"))
            want[k, n] = tuple(by.get(h) or None for h in names)
    df = spark.createDataFrame(texts, "source_pos int, source_id string, text string")
    got = {(r.source_pos, r.row_pos): tuple(r.r.fields[h] for h in names) for r in extract.csv_rows(df).collect()}
    assert got == want
    rows = spark.createDataFrame([(0, "s", 'name,name,email\nA,B,e@x.test\n5" pipe,C,f@x.test\n')], df.schema)
    assert [(r.r.fields.name, r.r.fields.email) for r in extract.csv_rows(rows).orderBy("row_pos").collect()] == [("A", "e@x.test"), ('5" pipe', "f@x.test")]


def test_folders_and_streams(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    for k in range(12):
        (drop / f"p{k:02}.csv").write_text(f"name,email\nPerson {chr(65 + k)},{'same' if k % 4 == 0 else k}@mail.test\n")
    sources = readers.folder_sources(spark, str(drop))
    assert [(r.source_pos, r.filename) for r in sources.orderBy("source_pos").collect()] == [(k, f"p{k:02}.csv") for k in range(12)]
    people = run_pipeline(spark, sources).projected.collect()
    assert len(people) == 10 and [p.full_name for p in people if "same@mail.test" in p.emails] == ["Person A"]
    store = Store(spark, str(tmp_path / "store"))
    watch(spark, str(drop), store, str(tmp_path / "checkpoint")).awaitTermination()
    run = store.runs().first()
    assert (run.status, run.source_count, run.profile_count) == ("completed", 12, 10)


def test_omitted_members(spark):
    config = parse_config({"fields": [{"path": "a.name", "from": "full_name", "type": "string"}, {"path": "a.years", "from": "years_experience", "type": "number"}, {"path": "place", "from": "location", "type": "object"}, {"path": "b.line", "from": "headline", "type": "string"}], "include_confidence": False, "include_provenance": False, "on_missing": "omit"})
    csv_text = 'name,email\n"Quote ""Q"" Ng",q@mail.test\n'
    profile = run_pipeline(spark, readers.inline_sources(spark, [{"filename": "p.csv", "content": csv_text}])).canonical
    place = F.struct(F.lit("Oslo").alias("city"), F.lit(None).cast("string").alias("region"), F.lit("NO").alias("country"))
    line = as_json(projected(profile.withColumn("location", place), config), config).first().json
    assert json.loads(line) == {"a": {"name": 'Quote "Q" Ng'}, "place": {"city": "Oslo", "region": None, "country": "NO"}}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    (tmp_path / "people.csv").write_text("name,email\nIvo Brand,ivo@mail.test\n")
    (tmp_path / "linkedin_ada-moss.json").write_text(json.dumps({"name": "Ada Moss", "emails": ["ada@mail.test"]}))
    (tmp_path / "gus.json").write_text(json.dumps({"name": "Gus Vale"}))
    (tmp_path / "blocked").write_text("a file where the store should be")
    assert main(["run", "--sources", f"{tmp_path}/people.csv", "--linkedin-url", "https://linkedin.com/in/ada-moss", "--linkedin-profiles", str(tmp_path), "--github-url", "https://github.com/gus", "--github-base", f"file://{tmp_path}", "--store", f"{tmp_path}/blocked/store"]) == 0
    out = capsys.readouterr()
    assert {json.loads(x)["full_name"] for x in out.out.splitlines() if x.startswith("{")} == {"Ivo Brand", "Ada Moss", "Gus Vale"}
    assert "not stored" in out.err


def test_csv_files_in_many_tasks(spark, tmp_path):
    """Files that are cut anywhere, by quotes, line feeds, CRLF and a byte-order mark, give what one task reads from each."""
    rng = random.Random(11)
    bits = ["a", '"', '""', ",", ";", "\n", "\r\n", " ", "é", '"x, y\nz"', '"q ""q"" q"', "name", ",,", "\n\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(90))) for _ in range(12)]
    out = io.StringIO()
    rows = [["name", "email", "title"]] + [[f"N {k}", f"n{k}@mail.test", rng.choice(["plain", 'with "quotes", and\r\nlines', "", "a\n\n\nb"])] for k in range(80)]
    csv.writer(out, delimiter=";").writerows(rows)
    texts += ["﻿" + out.getvalue(), "", "name,email\n", 'name,email\nAda,"never closed, x@y.zz\nBo,b@c.dd\n\nCy,c@d.ee\n', "name\temail\nAda\ta@b.cc\n", "name,title\rAda,x\rBo,y"]
    paths = []
    for k, text in enumerate(texts):
        paths.append(tmp_path / f"c {k} [1]{{x}}+%41.CSV")
        paths[-1].write_bytes(text.encode())
    whole = extract.csv_rows(spark.createDataFrame([(k, p.name, t) for k, (p, t) in enumerate(zip(paths, texts, strict=True))], "source_pos int, source_id string, text string"))
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("70b", sizes["spark.sql.files.maxPartitionBytes"]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0b" if size.endswith("0b") else sizes["spark.sql.files.openCostInBytes"])
            got = extract.csv_line_rows(readers.csv_lines(spark, list(map(str, paths))))
            assert sorted(got.collect(), key=str) == sorted(whole.collect(), key=str) and got.count() > 90
    finally:
        for k, v in sizes.items():
            spark.conf.set(k, v)


def test_files_of_any_name(spark, tmp_path):
    names = ["cv [1].txt", "a{b}.txt", "x?y.txt", "plain.txt", "cv 1.txt"]
    for n in names:
        (tmp_path / n).write_text(f"{n} text")
    paths, warnings = readers.resolve_paths(f"{tmp_path}")
    assert not warnings and len(paths) == 5
    assert {(r.source_pos, r.filename, bytes(r.content).decode()) for r in readers.file_sources(spark, paths).collect()} == {(k, p.rsplit("/", 1)[1], f"{p.rsplit('/', 1)[1]} text") for k, p in enumerate(paths)}
    stored, _ = readers.resolve_paths(f"file://{tmp_path}/p*.txt,file://{tmp_path}/none.txt", spark)
    assert len(stored) == 1 and [bytes(r.content) for r in readers.file_sources(spark, stored).collect()] == [b"plain.txt text"]


def test_profiles_of_the_sources(spark, tmp_path):
    """Users come from the sources themselves, by the first part of the link's path, and repositories by pages."""
    (tmp_path / "ada.json").write_text(json.dumps({"name": "Ada", "public_repos": 150}))
    (tmp_path / "ada.repos.json").write_text(json.dumps([{"language": "Rust"}] * 60 + [{"language": None}] * 40))
    (tmp_path / "ada.repos.2.json").write_text(json.dumps([{"language": "Go"}] * 61))
    sources = readers.inline_sources(spark, [{"url": "https://github.com/ada/repo?tab=x"}, {"content": "https://github.com/ada"}, {"filename": "note.txt", "content": "hello"}, {"url": "http://github.com/bo#x"}])
    for pages, languages in ((1, ["Rust"]), (2, ["Go", "Rust"])):
        got = {r.user: r for r in readers.fetched_profiles(sources, f"file://{tmp_path}", pages).collect()}
        assert got.keys() == {"ada", "bo"} and got["bo"].failed and (got["ada"].name, got["ada"].languages) == ("Ada", languages)
