import io
import json
import random
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kindred.operators import cluster, extract, normalize, resume
from kindred.plans import shape
from kindred.plans.config import DEFAULT, KindredError, parse_config
from kindred.plans.pipeline import run_pipeline, warnings_of
from kindred.plans.project import projected
from kindred.plans.store import Store
from kindred.sources import documents, readers

CSV = "name,email,phone,current_company,title\nNadia Brenner,nadia.brenner@mail.test,(206) 555-0188,Fjord,Analyst\n"
LINKEDIN = json.dumps({"name": "Nadia Brenner", "headline": "Analyst at Fjord", "emails": ["nadia.brenner@mail.test"], "phones": ["+12065550188"], "linkedin": "https://linkedin.com/in/nadia", "experience": [{"company": "Fjord", "title": "Analyst", "start": "2020-01", "end": "Present", "summary": "x"}]})
RESUME_A = "Ines Maro\nines@mail.test\n303-555-0123\n\nEXPERIENCE\nChief Brewer - Tundra Mills | Jan 2020 - Dec 2022\n- Built things\n\nEDUCATION\nTundra University, 2019\nBachelor in Computer Science\n"


def test_two_sources_give_one_profile(spark):
    sources = readers.inline_sources(spark, [{"filename": "people.csv", "content": CSV}, {"filename": "profile.json", "content": LINKEDIN}])
    result = run_pipeline(spark, sources)
    rows = result.projected.collect()
    assert len(rows) == 1
    p = rows[0]
    assert p.candidate_id == "574c87380964d90723da7891701c9405"
    assert (p.full_name, p.emails, p.phones, p.headline) == ("Nadia Brenner", ["nadia.brenner@mail.test"], ["+12065550188"], "Analyst at Fjord")
    assert [m.field for m in p.provenance if m.field == "emails[0]"] == ["emails[0]"] * 2
    assert len(p.experience) == 1
    assert result.warnings.count() == 0


def test_poor_input(spark):
    sources = readers.inline_sources(spark, [{"filename": "empty.csv", "content": "a,b,c\n"}, {"filename": "notes.txt", "content": "Someone quite unknown"}])
    p = run_pipeline(spark, sources).projected.first()
    assert (p.full_name, p.emails, p.phones, p.overall_confidence) == ("Someone quite unknown", [], [], 0.15)


def test_store_and_another_shape(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    result = run_pipeline(spark, readers.inline_sources(spark, [{"filename": "people.csv", "content": CSV}]), store=store)
    assert store.runs().first().status == "completed"
    config = {"fields": [{"path": "label", "from": "full_name", "type": "string", "required": True}, {"path": "reach.first_mail", "from": "emails[0]", "type": "string"}, {"path": "worked_years", "from": "years_experience", "type": "number"}], "include_provenance": False}
    p = store.reproject(result.run_id, config).first()
    assert (p.label, p.reach.first_mail, p.worked_years, p.overall_confidence) == ("Nadia Brenner", "nadia.brenner@mail.test", None, 0.9)
    assert "provenance" not in p
    for run_id, code in (("none", "INVALID_RUN_ID"), ("0" * 24, "RUN_NOT_FOUND")):
        with pytest.raises(KindredError) as e:
            store.run(run_id)
        assert e.value.code == code
    with pytest.raises(KindredError) as e:
        store.reproject(result.run_id, None)
    assert e.value.code == "MISSING_CONFIG"
    with pytest.raises(KindredError) as e:
        Store(spark, str(tmp_path / "none")).runs()
    assert e.value.code == "DATABASE_UNAVAILABLE"
    store.save_config("short", {"fields": []})
    assert store.configs().count() == 1 and store.health()["status"] == "UP"


def test_runs_are_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A run that breaks off between its two tables, one with two profiles of an id, and a second writer of a run."""
    store = Store(spark, str(tmp_path))
    raw = spark.createDataFrame([(1, "a"), (2, "b")], "rec_ord long, source_id string")
    one, two, twice = (spark.createDataFrame(rows, "candidate_id string, full_name string") for rows in ([("x", "X")], [("x", "Y"), ("z", "Z")], [("x", "X"), ("x", "Y")]))

    def told(run_id):
        run, raws, profiles = store.run(run_id)
        return run.first().status, raws.count(), sorted(r.full_name for r in profiles.collect())

    first = store.start()
    store.save(first, raw, one)
    store.note(first, "completed")
    broken, refused = store.start(), store.start()
    with monkeypatch.context() as m:
        m.setattr(store, "save_profiles", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.save(broken, raw, one)
    with pytest.raises(KindredError) as e:
        store.save(refused, raw, twice)
    assert e.value.code == "DUPLICATE_CANDIDATE"
    with pytest.raises(KindredError) as e:
        store.save(first, raw, two)
    assert e.value.code == "DUPLICATE_CANDIDATE"
    assert told(first) == ("completed", 2, ["X"]) and told(broken) == ("partial", 0, []) and told(refused) == ("partial", 0, [])
    store.save(broken, raw, two)
    assert told(broken) == ("partial", 2, ["Y", "Z"])


def test_config_faults():
    for bad in ({"fields": [{"path": "a[0]", "from": "x", "type": "string"}]}, {"fields": [{"path": "a", "from": "x", "type": "string"}, {"path": "a.b", "from": "x", "type": "string"}]}, {"fields": [{"path": "a", "from": "x", "type": "other"}]}):
        with pytest.raises(KindredError):
            parse_config(bad)
    assert DEFAULT.fields[0].required


def test_shape(spark):
    """Declared types, and faults by path in texts from elsewhere and in projections, as they are written."""
    config = parse_config({"fields": [{"path": "who.name", "from": "full_name", "type": "string", "required": True}, {"path": "who.mails", "from": "emails", "type": "string[]"}, {"path": "rest", "from": "links", "type": "object"}], "include_provenance": False})
    schema = shape.output_schema(config)
    assert schema.simpleString() == "struct<who:struct<name:string,mails:array<string>>,rest:variant,overall_confidence:double>"
    assert not schema["who"].nullable and not schema["who"].dataType["name"].nullable and schema["who"].dataType["mails"].nullable
    bodies = {
        '{"who": {"name": "A", "mails": ["a"]}, "rest": {}, "more": 1}': [], '{"who": {"name": null, "mails": ["a", 2, null]}, "rest": [1]}': ["who.name is missing", "who.mails[1] isn't a text", "who.mails[2] is missing"],
        '{"who": [], "rest": "x", "overall_confidence": -1}': ["who isn't a record", "rest isn't a record or a list", "overall_confidence isn't from 0 to 1"], "{}": ["who is missing"], "no": [" is missing"], None: [" is missing"], "[]": [" isn't a record"],
    }
    rows = spark.createDataFrame([(b,) for b in bodies], "body string").select("body", shape.json_faults(F.col("body"), config).alias("f")).collect()
    assert {r.body: [f"{x.path} {x.fault}" for x in r.f] for r in rows} == bodies
    people = spark.createDataFrame([(1, "A", ["a", None], 0.5), (2, None, None, 1.5), (3, "C", [], float("nan"))], "group_id long, full_name string, emails array<string>, overall_confidence double")
    told = lambda on_missing, *fields: {r.group_id: r.faults for r in shape.with_faults(projected(people, replace(config, on_missing=on_missing, fields=fields or config.fields[:2]), ("group_id",)), replace(config, on_missing=on_missing, fields=fields or config.fields[:2])).collect()}
    beyond, nan = "overall_confidence isn't from 0 to 1", "overall_confidence isn't a number"
    assert told("null") == {1: ["who.mails[1] is missing"], 2: ["who.name is missing", beyond], 3: [nan]}
    # What is omitted takes a record without members with it, and NaN is written as a text.
    assert told("omit", config.fields[1]) == {1: ["who.mails[1] is missing"], 2: ["who is missing", beyond], 3: [nan]}
    assert shape.with_faults(people, replace(config, fields=None)).first().faults == []


def test_warnings_of_normalization(spark):
    jobs = [None, ("F", "R", "May 2020", None, None)]
    raw = spark.createDataFrame([(1, "a", "ats_json", 0.9, (jobs, ["Go", None])), (2, "b", "ats_json", 0.9, (jobs[1:], None))], f"rec_ord long, source_id string, source_type string, raw_confidence double, told struct<experience:{extract.JOBS},skills:array<string>>")
    raw = raw.select("rec_ord", "source_id", "source_type", extract.record(F.col("raw_confidence"), experience=F.col("told.experience"), skills=F.col("told.skills")).alias("r")).select("rec_ord", "source_id", "source_type", "r.*")
    records = normalize.normalized(raw)
    got = {r.source_id: r for r in records.collect()}
    assert [(j.company, j.start) for j in got["a"].experience] == [("F", "May 2020")] and got["a"].faults == ["experience", "skills"] and [s.name for s in got["a"].skills] == ["Go"]
    assert [(j.company, j.start) for j in got["b"].experience] == [("F", "2020-05")] and got["b"].faults == []
    none = spark.createDataFrame([], "candidate_id string, group_id long, faults array<string>, warnings array<string>")
    assert [(w.stage, w.subject) for w in warnings_of(raw, records, none, none).collect()] == [("normalize", "a")]


def test_resume(spark):
    r = spark.createDataFrame([(RESUME_A,)], "t string").select(resume.fields(F.col("t")).alias("r")).first().r
    assert r.name == "Ines Maro" and r.emails == ["ines@mail.test"]
    (job,), (school,) = r.experience, r.education
    assert (job.company, job.title, job.start, job.end, job.summary) == ("Tundra Mills", "Chief Brewer", "2020-01", "2022-12", "Built things")
    assert (school.institution, school.degree, school.field, school.end_year) == ("Tundra University", "Bachelor", "Computer Science", 2019)


def test_documents():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Ines</w:t></w:r></w:p><w:p><w:r><w:t>Maro</w:t></w:r></w:p></w:body></w:document>')
    assert documents.docx_text(buffer.getvalue()) == "Ines\nMaro"
    assert documents.docx_text(b"no") is None
    pdf = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\nBT (Ines \\(J\\)) Tj T* (Maro) Tj ET\nendstream\nendobj"
    assert documents.pdf_text(pdf) == "Ines (J)\nMaro"
    assert documents.pdf_text(b"no") is None


def test_bad_json_gives_an_empty_record(spark):
    r = spark.createDataFrame([("{no",)], "t string").select(extract.ats_record(F.col("t")).alias("r")).first().r
    assert r.raw_confidence == 0.0 and r.fields.name is None


def greedy(people):
    """Groups by the definition: each record goes to the first group with a match."""
    groups = []
    for p in people:
        for g in groups:
            if any(set(p[1]) & set(q[1]) or set(p[2]) & set(q[2]) for q in g):
                g.append(p)
                break
        else:
            groups.append([p])
    return {p[0]: g[0][0] for g in groups for p in g}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cluster_is_greedy(spark, seed):
    rng = random.Random(seed)
    people = [(k, [f"e{rng.randrange(60)}" for _ in range(rng.randrange(3))], [f"p{rng.randrange(40)}" for _ in range(rng.randrange(2))]) for k in range(120)]
    df = spark.createDataFrame([(k, None, e, p) for k, e, p in people], "rec_ord long, full_name string, emails array<string>, phones array<string>").repartition(3)
    assert {r.rec_ord: r.group_id for r in cluster.cluster(df).collect()} == greedy(people)


def test_linkedin_by_link(spark):
    rows = [(0, "a", "linkedin_json", "https://www.linkedin.com/in/nadia/", "https://www.linkedin.com/in/nadia/"), (1, "b", "linkedin_json", "https://www.linkedin.com/in/petra-van-dijk-7c01f44e2/", "https://www.linkedin.com/in/petra-van-dijk-7c01f44e2/")]
    sources = spark.createDataFrame(rows, "source_pos int, source_id string, source_type string, url string, text string")
    fixtures = spark.createDataFrame([("Nadia", LINKEDIN)], "slug string, body string")
    got = {r.source_id: r for r in extract.raw_records(extract.with_fixtures(sources, fixtures)).collect()}
    assert (got["a"].fields.name, got["a"].raw_confidence) == ("Nadia Brenner", 0.9)
    assert (got["b"].fields.name, got["b"].raw_confidence, got["b"].fields.headline) == ("Petra Van Dijk", 0.3, None)


def test_resolve_paths(tmp_path):
    for n in ("a.CSV", "b.csv", "c.txt"):
        (tmp_path / n).write_text("x")
    found, warnings = readers.resolve_paths(f"{tmp_path}/*.csv,{tmp_path}/none.txt,{tmp_path}/b.csv")
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.CSV", "b.csv"] and len(warnings) == 1


def test_github_source(spark, tmp_path):
    (tmp_path / "ann.json").write_text(json.dumps({"name": "Ann", "public_repos": 3}))
    (tmp_path / "ann.repos.json").write_text(json.dumps([{"language": "Go"}, {"language": "Rust"}, {"language": "Rust"}, {"language": None}]))
    spark.dataSource.register(readers.GithubProfiles)
    rows = {r.user: r for r in spark.read.format("github_profiles").options(users="ann,bob", base=f"file://{tmp_path}").load().collect()}
    assert rows["ann"].languages == ["Rust", "Go"] and rows["bob"].failed
