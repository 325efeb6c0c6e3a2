"""Plans stay small: each holds what its rows need once."""

import json

from pyspark.sql import functions as F

from kindred.operators import extract, merge
from kindred.plans import queries
from kindred.plans.pipeline import raw_tables, run_pipeline, typed_text
from kindred.sources import readers


def test_a_run_extracts_the_kinds_it_has(spark, monkeypatch):
    def never(_):
        raise AssertionError("no source is of this kind")

    for kind in set(extract.EXTRACTORS) - {"ats_json"}:
        monkeypatch.setitem(extract.EXTRACTORS, kind, never)
    body = json.dumps({"cand_full_name": "Ines Maro", "email_addr": "ines@mail.test"})
    assert run_pipeline(spark, readers.inline_sources(spark, [{"filename": "a.json", "content": body}])).projected.first().full_name == "Ines Maro"


def test_kinds_one_by_one_give_all_records(spark):
    contents = {"a.json": json.dumps({"cand_full_name": "Ines Maro"}), "b.json": "{broken", "c.csv": "name,email\nA B,a@x.org\nC D,c@x.org\n", "d.txt": "Ana Roy\nana@x.org\n", "e.json": json.dumps({"headline": "Analyst", "name": "E F"})}
    typed = typed_text(readers.inline_sources(spark, [{"filename": n, "content": c} for n, c in contents.items()])).cache()
    told = lambda df: sorted(df.select("rec_ord", "source_id", "source_type", "raw_confidence", F.to_json("candidate_hint"), F.to_json("fields")).collect())
    got = told(raw_tables(typed))
    assert got == told(extract.raw_records(typed)) and len(got) == 6 and len({r.source_type for r in got}) == 4


def test_profiles_work_out_their_parts_once(spark, sf_dir, monkeypatch):
    made = []
    for name in ("ranked", "merged_skills", "merged_experience", "merged_education", "provenance"):
        own = getattr(merge, name)
        monkeypatch.setattr(merge, name, lambda *a, own=own, name=name: made.append(name) or own(*a))
    queries.QUERIES["canonical_profiles"](spark, sf_dir)
    assert sorted(made) == ["merged_education", "merged_experience", "merged_skills", "provenance", "ranked"]
