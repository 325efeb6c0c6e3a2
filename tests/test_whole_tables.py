"""Queries read their whole tables, whatever the keys and texts."""

import re

from kindred.plans import queries


def test_project_nested_has_every_customer(spark, tmp_path):
    keys = [1, 9_999, 10_000, 15_000, 4_500_000]
    customers = spark.createDataFrame([(k, f"Customer#{k}", "MACHINERY", 1.0) for k in keys], "c_custkey long, c_name string, c_mktsegment string, c_acctbal double")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    rows = {r.group_id: r.phone for r in queries.QUERIES["project_nested"](spark, str(tmp_path)).collect()}
    assert rows == {1: "+14155550001", 9_999: "+14155559999", 10_000: "+14155560000", 15_000: "+14155565000", 4_500_000: "+14160050000"}


def test_keyword_terms_reads_every_text(spark, tmp_path):
    texts = {1: "The token", 2: "Der Schlüssel für den Zugang", 3: "“the” license…", 4: "éla la", 5: "laß, tokens, theé", 6: None, 7: "", 8: "general\npublic General Public_", 9: "漢字the字"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stands = lambda t, text: re.search(f"(^|[^A-Za-z0-9_]){t}([^A-Za-z0-9_]|$)", text or "", re.IGNORECASE | re.ASCII)
    want = {k: "|".join("article" if t == "the" else t for t in queries.TERMS if stands(t, text)) for k, text in texts.items()}
    assert {r.doc_id: r.terms for r in queries.QUERIES["keyword_terms"](spark, str(tmp_path)).collect()} == want
    assert want[2] == "den" and want[3] == "article|license" and want[9] == "article" and want[6] == ""


def test_name_links_are_all_pairs_of_equal_names(spark, tmp_path):
    """Keys beyond 99,999 lose digits in the name, so several customers have one; the links are those of the SQL."""
    import duckdb

    keys = [7, 10_000, 100_000, 100_001, 100_004, 100_009]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k,) for k in keys[:4]], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in (3, 8)], "user_id long").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    for name in ("customer", "orders", "events"):
        duck.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(duck.sql(queries.ORACLE["match_links_name"]).fetchall())
    got = queries.QUERIES["match_links_name"](spark, str(tmp_path)).select("later", "earlier")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 1 + 8 * 7 // 2


def test_resumes_of_a_small_file_are_many_tasks(spark, sf_dir):
    resumes = queries.resumes(spark, sf_dir)
    assert len(spark.read.parquet(f"{sf_dir}/customer.parquet").inputFiles()) == 1 and resumes.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_csv_rows_do_not_carry_their_whole_text(spark, sf_dir):
    plan = queries.QUERIES["csv_rows"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    told = re.findall(r"Generate posexplode\((.*?)\), \[([^\]]*)\]", plan)
    first, dropped = told[0]
    # The list in brackets is of the columns that end with the generator: all records.
    assert len(told) == 1 and dropped != "" and re.fullmatch(r"records#\d+", first)
