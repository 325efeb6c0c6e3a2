"""The catalogue of queries over the driver's tables, and their SQL for another engine.

Person records are derived from customers, orders and events: three sources that overlap by email, phone and name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import fuzzy, present, scalars, text
from kindred.operators import cluster, confidence, extract, merge
from kindred.plans import project
from kindred.plans.config import OutputConfig, OutputField
from kindred.plans.tables import kept, merging, spread
from kindred.sources import detect

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


# ---------------------------------------------------------------- derived records

RECS = """recs AS (
 SELECT cast(c_custkey*10+1 AS bigint) rec_ord, concat('ats.json#',c_custkey) source_id, 'ats_json' source_type, cast(0.95 AS double) raw_confidence,
        concat('Customer Num',lpad(cast(c_custkey AS varchar),5,'0')) full_name, concat('cust',c_custkey,'@example.com') email,
        concat('+1415',lpad(cast(c_custkey AS varchar),7,'0')) phone FROM customer
 UNION ALL
 SELECT cast(o_custkey*10+2 AS bigint), concat('recruiter.csv#row',o_custkey), 'recruiter_csv', cast(0.9 AS double),
        concat('Customer X. Num',lpad(cast(o_custkey AS varchar),5,'0')),
        CASE WHEN o_custkey%3=0 THEN concat('cust',o_custkey,'@example.com') END,
        CASE WHEN o_custkey%2=0 THEN concat('+1415',lpad(cast(o_custkey AS varchar),7,'0')) END
   FROM (SELECT DISTINCT o_custkey FROM orders) o
 UNION ALL
 SELECT cast(user_id*10+3 AS bigint), concat('github:',user_id), 'github_api', cast(0.8 AS double),
        CASE WHEN user_id%4=0 THEN concat('u',user_id) END,
        CASE WHEN user_id%5<>0 THEN concat('cust',user_id,'@example.com') END, cast(NULL AS varchar)
   FROM (SELECT DISTINCT user_id FROM events) e)"""

LINKS = """words AS (SELECT rec_ord, list_filter(string_split_regex(trim(regexp_replace(lower(full_name),'[.,]',' ','g')),'\\s+'), lambda x: x<>'') w FROM recs WHERE full_name IS NOT NULL),
 tok AS (SELECT DISTINCT rec_ord, unnest(w) t FROM words),
 namepairs AS (SELECT DISTINCT a.rec_ord later, b.rec_ord earlier FROM tok a JOIN tok b ON a.t=b.t AND a.rec_ord>b.rec_ord WHERE a.t<>'customer' AND a.t<>'x'),
 nameedges AS (SELECT p.later, p.earlier FROM namepairs p JOIN words x ON x.rec_ord=p.later JOIN words y ON y.rec_ord=p.earlier
   WHERE least(len(x.w),len(y.w))>1 AND len(list_filter(x.w, lambda v: list_contains(y.w,v)))=least(len(x.w),len(y.w))),
 edges AS (SELECT a.rec_ord later, b.rec_ord earlier FROM recs a JOIN recs b ON a.email=b.email AND a.rec_ord>b.rec_ord
   UNION SELECT a.rec_ord, b.rec_ord FROM recs a JOIN recs b ON a.phone=b.phone AND a.rec_ord>b.rec_ord
   UNION SELECT later, earlier FROM nameedges),
 walk(id,root) AS (SELECT rec_ord, rec_ord FROM recs WHERE rec_ord NOT IN (SELECT later FROM edges)
   UNION SELECT e.later, walk.root FROM walk JOIN edges e ON e.earlier=walk.id),
 grp AS (SELECT id rec_ord, min(root) group_id FROM walk GROUP BY id),
 g AS (SELECT recs.*, grp.group_id FROM recs JOIN grp USING(rec_ord))"""
GROUPED = f"WITH RECURSIVE {RECS}, {LINKS} "
def fixed2_sql(x: str) -> str:
    """`fixed2` of an expression over columns, without subqueries."""
    p, xh = f"(({x})*100e0)", f"((134217729e0*({x}))-((134217729e0*({x}))-({x})))"
    err = f"(({xh}*100e0-{p})+(({x})-{xh})*100e0)"
    return f"((floor({p})+(CASE WHEN {p}-floor({p})>0.5 OR ({p}-floor({p})=0.5 AND {err}>=0) THEN 1 ELSE 0 END))/100e0)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records in normal form."""
    key = lambda c: F.col(c).cast("string")
    person = lambda df, c, ord_, source, kind, conf, name, email, phone: df.select(
        (F.col(c) * 10 + ord_).cast("long").alias("rec_ord"), F.concat(F.lit(source), key(c)).alias("source_id"), F.lit(kind).alias("source_type"), F.lit(conf).alias("raw_confidence"),
        name.alias("full_name"), F.array_compact(F.array(email)).alias("emails"), F.array_compact(F.array(phone)).alias("phones"),
    )
    padded = lambda c, n: F.lpad(key(c), n, "0")
    mail, tel = lambda c: F.concat(F.lit("cust"), key(c), F.lit("@example.com")), lambda c: F.concat(F.lit("+1415"), padded(c, 7))
    none = F.lit(None).cast("string")
    ats = person(table(spark, sf_dir, "customer"), "c_custkey", 1, "ats.json#", "ats_json", 0.95, F.concat(F.lit("Customer Num"), padded("c_custkey", 5)), mail("c_custkey"), tel("c_custkey"))
    o = F.col("o_custkey")
    csv = person(table(spark, sf_dir, "orders").select("o_custkey").distinct(), "o_custkey", 2, "recruiter.csv#row", "recruiter_csv", 0.9, F.concat(F.lit("Customer X. Num"), padded("o_custkey", 5)), F.when(o % 3 == 0, mail("o_custkey")), F.when(o % 2 == 0, tel("o_custkey")))
    u = F.col("user_id")
    git = person(table(spark, sf_dir, "events").select("user_id").distinct(), "user_id", 3, "github:", "github_api", 0.8, F.when(u % 4 == 0, F.concat(F.lit("u"), key("user_id"))), F.when(u % 5 != 0, mail("user_id")), none)
    return ats.unionByName(csv).unionByName(git)


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster(records(spark, sf_dir))


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grouped() with every field of the normal form: skills from events, jobs from orders, places from nations."""
    recs = grouped(spark, sf_dir)
    ev = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    skills = ev.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("name"), F.lit(0.8).alias("confidence")))).alias("skills")).select((F.col("user_id") * 10 + 3).cast("long").alias("rec_ord"), "skills")
    day = F.date_format("o_orderdate", "yyyy-MM")
    jobs = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("company"), F.col("o_orderstatus").alias("title")).agg(F.min(day).alias("start"), F.max(day).alias("end"))
    jobs = jobs.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("company", "title", "start", "end", F.lit(None).cast("string").alias("summary")))).alias("experience")).select((F.col("o_custkey") * 10 + 2).cast("long").alias("rec_ord"), "experience")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    place = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select((F.col("c_custkey") * 10 + 1).cast("long").alias("rec_ord"), F.struct(F.lit(None).cast("string").alias("city"), F.col("c_mktsegment").alias("region"), scalars.country(F.col("n_name")).alias("country")).alias("location"))
    school = F.array().cast("array<struct<institution:string,degree:string,field:string,end_year:int>>")
    empty = lambda kind: F.array().cast(kind)
    out = recs.join(merging(skills), "rec_ord", "left").join(merging(jobs), "rec_ord", "left").join(merging(place), "rec_ord", "left")
    github = F.when(F.col("source_type") == "github_api", F.concat(F.lit("https://github.com/"), F.regexp_extract("source_id", r"(\d+)$", 1)))
    links = F.struct(F.lit(None).cast("string").alias("linkedin"), github.alias("github"), F.lit(None).cast("string").alias("portfolio"), empty("array<string>").alias("other"))
    full = out.select(*recs.columns, "location", links.alias("links"), F.when(F.col("source_type") == "ats_json", F.concat(F.lit("Head of "), F.col("location.region"))).alias("headline"), F.lit(None).cast("double").alias("years_experience"),
                      F.coalesce("skills", empty("array<struct<name:string,confidence:double>>")).alias("skills"), F.coalesce("experience", empty("array<struct<company:string,title:string,start:string,end:string,summary:string>>")).alias("experience"), school.alias("education"))
    return kept(full, "full")  # merging reads it many times


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.scored_profiles(full_records(spark, sf_dir))


# ---------------------------------------------------------------- text

ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x)=i)"


def _distinct_sql(x: str) -> str:
    return ORDERED.format(x)


@query(f"SELECT doc_id, array_to_string(e,'|') AS emails, len(e) AS n FROM (SELECT doc_id, {_distinct_sql('l')} e FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}'), lambda x: lower(x)) l FROM documents) a) b")
def extract_emails(spark, sf_dir):
    e = text.emails(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", joined(e).alias("emails"), F.size(e).cast("long").alias("n"))


@query(f"SELECT doc_id, array_to_string(e,'|') AS phones, len(e) AS n FROM (SELECT doc_id, {_distinct_sql('l')} e FROM (SELECT doc_id, regexp_extract_all(text, '(?:\\+?\\d{{1,3}}[-.\\s]?)?\\(?\\d{{3}}\\)?[-.\\s]?\\d{{3}}[-.\\s]?\\d{{4}}') l FROM documents) a) b")
def extract_phones(spark, sf_dir):
    e = text.phones(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", joined(e).alias("phones"), F.size(e).cast("long").alias("n"))


@query("SELECT page_id, array_to_string(list_transform(regexp_extract_all(concat('see ',url,', or ',url,'). '), 'https?://[^\\s$.?#].[^\\s]*'), lambda u: regexp_replace(u,'[,;.)]$','')),'|') AS urls FROM pages")
def extract_urls(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", joined(text.urls(F.concat(F.lit("see "), u, F.lit(", or "), u, F.lit("). ")))).alias("urls"))


@query("SELECT page_id, concat('https://github.com/u',page_id) AS github, concat('https://linkedin.com/in/p',page_id) AS linkedin, CASE WHEN page_id%2=0 THEN concat('https://my.blog.net/',page_id) END AS portfolio, concat('http://example.org/',page_id) AS other FROM pages")
def route_links(spark, sf_dir):
    k = F.col("page_id").cast("string")
    note = F.concat(F.lit("me: github.com/u"), k, F.lit("; linkedin.com/in/p"), k, F.lit(", http://example.org/"), k, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" https://my.blog.net/"), k)).otherwise(""))
    got = text.links(note)
    return table(spark, sf_dir, "pages").select("page_id", got["github"].alias("github"), got["linkedin"].alias("linkedin"), got["portfolio"].alias("portfolio"), F.array_join(got["other"], "|").alias("other"))


LINES_SQL = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x,'^[\\s\\x{00a0}\\x{feff}]+',''),'[\\s\\x{00a0}\\x{feff}]+$','')), lambda x: length(x)>0)"


@query(f"SELECT doc_id, len(l) AS n_lines, coalesce(list_filter(l, lambda x: NOT contains(x,'@') AND NOT regexp_matches(x,'\\d{{4}}') AND NOT contains(lower(x),'resume') AND NOT contains(lower(x),'curriculum') AND len(string_split_regex(x,'\\s+')) BETWEEN 2 AND 4 AND len(list_filter(string_split_regex(x,'\\s+'), lambda w: NOT regexp_matches(w,'^[A-Za-z]')))=0)[1], l[1]) AS name FROM (SELECT doc_id, {LINES_SQL} l FROM documents) a")
def name_heuristic(spark, sf_dir):
    ls = table(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text")).alias("l"))
    return ls.select("doc_id", F.size("l").cast("long").alias("n_lines"), text.name(F.col("l")).alias("name"))


TERMS = ("the", "license", "token", "General Public", "la", "den", "Version")


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text,'(?i)(^|[^A-Za-z0-9_]){t}([^A-Za-z0-9_]|$)') THEN '{'article' if t == 'the' else t}' END" for t in TERMS) + "], lambda x: x IS NOT NULL),'|') AS terms FROM documents")
def keyword_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", joined(text.keywords(F.col("text"), TERMS, {"the": "article"})).alias("terms"))


@query("SELECT o_orderkey, CASE o_orderkey%3 WHEN 1 THEN strftime(o_orderdate,'%Y-01') ELSE strftime(o_orderdate,'%Y-%m') END AS \"start\", CASE o_orderkey%3 WHEN 0 THEN 'Present' WHEN 1 THEN strftime(o_orderdate + INTERVAL 400 DAY,'%Y-01') END AS \"end\", CASE o_orderkey%3 WHEN 0 THEN strftime(o_orderdate,'%B %Y - Present') WHEN 1 THEN concat(strftime(o_orderdate,'%Y'),' - ',strftime(o_orderdate + INTERVAL 400 DAY,'%Y')) ELSE strftime(o_orderdate,'%Y/%m') END AS span FROM orders")
def date_ranges(spark, sf_dir):
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 3
    later = d + F.expr("INTERVAL 400 DAY")
    line = F.concat(F.lit("Engineer "), F.when(kind == 0, F.concat(F.date_format(d, "MMMM yyyy"), F.lit(" - Present"))).when(kind == 1, F.concat(F.date_format(d, "yyyy"), F.lit(" - "), F.date_format(later, "yyyy"))).otherwise(F.date_format(d, "yyyy/MM")), F.lit(" (Acme)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.date_range(line).alias("r")).select("o_orderkey", "r.*")


@query(f"WITH l AS (SELECT doc_id, unnest({LINES_SQL}) line, generate_subscripts({LINES_SQL},1) pos FROM documents), m AS (SELECT doc_id, pos, sum(CASE WHEN len(string_split_regex(line,'\\s+'))<=3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) block FROM l) SELECT doc_id, cast(block AS bigint) AS block, count(*) AS n, min(pos)-1 AS first_pos FROM m WHERE block>0 GROUP BY doc_id, block")
def line_blocks(spark, sf_dir):
    from kindred.operators.resume import blocks_of

    rows = table(spark, sf_dir, "documents").select("doc_id", text.lines(F.col("text")).alias("l"))
    found = blocks_of(F.col("l"), lambda x: F.size(F.split(x, r"\s+")) <= 3)
    out = rows.select("doc_id", F.posexplode(found).alias("k", "b"))
    return out.select("doc_id", (F.col("k") + 1).cast("long").alias("block"), F.size("b.lines").cast("long").alias("n"), F.col("b.first").cast("long").alias("first_pos"))


# ---------------------------------------------------------------- typing and normal forms

NAMES = ("'people.CSV'", "'cv.pdf'", "'cv.docx'", "'a.b.txt'", "'ats.json'", "'x.json'", "'none'", "''")


@query("SELECT page_id, CASE page_id%10 WHEN 8 THEN 'github_api' WHEN 9 THEN 'linkedin_json' WHEN 0 THEN 'recruiter_csv' WHEN 1 THEN 'resume_pdf' WHEN 2 THEN 'resume_docx' WHEN 3 THEN 'recruiter_notes' WHEN 4 THEN 'ats_json' WHEN 5 THEN 'linkedin_json' WHEN 6 THEN 'recruiter_csv' ELSE 'recruiter_notes' END AS source_type FROM pages")
def detect_source_type(spark, sf_dir):
    k = (F.col("page_id") % 10).cast("int")
    name = F.get(F.array(*[F.expr(n) for n in NAMES], F.lit(""), F.lit("")), k)
    body = F.when(k == 4, '{"cand_full_name": "A"}').when(k == 5, '{"headline": "x", "name": "A"}').when(k == 6, "name,email,phone\nA,b@c.d,1").otherwise("free text")
    url = F.when(k == 8, "https://GitHub.com/a").when(k == 9, "https://www.linkedin.com/in/a").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", detect.source_type(body, name, url).alias("source_type"))


@query("SELECT page_id, CASE WHEN page_id%3=0 THEN url WHEN page_id%3=1 THEN concat('https://', regexp_replace(url,'^https?://','')) END AS link, concat(upper(substr(concat('page',page_id),1,1)), substr(concat('page',page_id),2), ' McX') AS name FROM pages")
def url_and_slug(spark, sf_dir):
    k = F.col("page_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("  "), F.col("url"), F.lit("\t"))).when(k == 1, F.regexp_replace("url", "^https?://", "")).otherwise("not a url")
    slug = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit("-mcX-7c01f44e2"))
    return table(spark, sf_dir, "pages").select("page_id", scalars.link(raw).alias("link"), scalars.slug_name(slug).alias("name"))


@query("SELECT c_custkey, concat('+1415',lpad(cast(c_custkey AS varchar),7,'0')) AS us, concat('+44',lpad(cast(c_custkey AS varchar),10,'0')) AS gb, concat('ab-',c_custkey%100) AS odd FROM customer")
def phone_e164(spark, sf_dir):
    n = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    us = F.concat(F.when(F.col("c_custkey") % 2 == 0, "1-"). otherwise(""), F.lit("(415) "), F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 4))
    gb = F.concat(F.lit("+44 (0)"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit(" ext. 12"))
    odd = F.concat(F.lit(" ab-"), (F.col("c_custkey") % 100).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.e164(us).alias("us"), scalars.e164(gb).alias("gb"), scalars.e164(odd).alias("odd"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey%8=6 THEN NULL WHEN o_orderkey%8=7 THEN strftime(o_orderdate,'%Y-01') ELSE strftime(o_orderdate,'%Y-%m') END AS month FROM orders")
def month_normalize(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    forms = ("yyyy-MM", "MMM yyyy", "MMMM, yyyy", "MM/yyyy", "yyyy/M", "yyyy/MM/dd")
    raw = F.when(k == 6, "Present").when(k == 7, F.date_format(d, "yyyy"))
    for i, form in enumerate(forms):
        raw = raw.when(k == i, F.concat(F.lit(" "), F.date_format(d, form)))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.month(raw).alias("month"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey%4=0 THEN 'US' WHEN n_nationkey%4=1 THEN 'GB' WHEN n_nationkey%4=2 THEN 'CA' ELSE substr(upper(n_name),1,2) END AS country FROM nation")
def country_map(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    raw = F.when(k == 0, "usa ").when(k == 1, "United Kingdom").when(k == 2, "ca").otherwise(F.lower("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.country(raw).alias("country"))


CSV_ROWS = "SELECT c_nationkey AS source_pos, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)-1 AS row_pos, concat('The \"', c_name, '\"') AS name, CASE WHEN c_custkey%4<>0 THEN concat('c',c_custkey,'@x.org') END AS email, concat(c_mktsegment, ', ', chr(10), 'Inc') AS current_company FROM customer"


def csv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV texts, one a nation, with quotes, delimiters and line feeds in cells, a repeated column and short rows."""
    c, quote = table(spark, sf_dir, "customer"), F.lit('"')
    email = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.org"))).otherwise("")
    line = F.concat(quote, F.lit('The ""'), "c_name", F.lit('""'), quote, F.lit(","), quote, "c_mktsegment", F.lit(", \n"), F.lit("Inc"), quote, F.lit(","), email, F.when(F.col("c_custkey") % 2 == 0, F.lit(",again")).otherwise(""))
    rows = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("rows"))
    text = F.concat(F.lit("name,current_company,email,name\r\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\r\n\r\n"))
    return rows.select(F.col("c_nationkey").alias("source_pos"), F.col("c_nationkey").cast("string").alias("source_id"), text.alias("text"))


@query(CSV_ROWS)
def csv_rows(spark, sf_dir):
    got = extract.csv_rows(csv_texts(spark, sf_dir))
    return got.select("source_pos", F.col("row_pos").cast("long").alias("row_pos"), "r.fields.name", "r.fields.email", "r.fields.current_company")


@query(CSV_ROWS)
def csv_line_rows(spark, sf_dir):
    """The same from lines, in ranges of seven lines that cut through cells."""
    lines = csv_texts(spark, sf_dir).select("source_pos", "source_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "value"))
    got = extract.csv_line_rows(lines.select("source_pos", "source_id", (F.col("line") - F.col("line") % 7).cast("long").alias("range"), F.col("line").cast("long").alias("line"), "value"))
    return got.select("source_pos", F.col("row_pos").cast("long").alias("row_pos"), "r.fields.name", "r.fields.email", "r.fields.current_company")


@query("SELECT c_custkey, CASE c_custkey%5 WHEN 0 THEN ';' WHEN 1 THEN chr(9) WHEN 2 THEN '|' ELSE ',' END AS mark FROM customer")
def csv_delimiter(spark, sf_dir):
    """Texts with other delimiters in quoted cells, and in every fifth no delimiter at all."""
    k = F.col("c_custkey") % 5
    mark = F.when(k == 0, ";").when(k == 1, "\t").when(k == 2, "|").otherwise(",")
    row = lambda a, b, c: F.when(k == 4, F.col("c_name")).otherwise(F.concat(a, mark, b, mark, c))
    text = F.concat_ws("\n", row(F.lit("name"), F.lit("title"), F.lit("phone")), row(F.col("c_name"), F.lit("\"a, b; c\""), F.col("c_acctbal").cast("string")), F.lit(""), row(F.col("c_name"), F.concat(F.lit('"x\t| '), F.col("c_mktsegment"), F.lit('\n, ; |"')), F.lit("")))
    return table(spark, sf_dir, "customer").select("c_custkey", extract.delimiter(text).alias("mark"))


@query("SELECT c_custkey, c_name AS name, concat('c',c_custkey,'@x.org') AS email, c_mktsegment AS current_company, CASE WHEN c_custkey%2=0 THEN c_acctbal END AS years_experience, cast(0.95 AS double) AS raw_confidence FROM (SELECT *, c_custkey%5=0 AS bad FROM customer) x WHERE NOT bad UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, cast(0.0 AS double) FROM customer WHERE c_custkey%5=0")
def ats_json_map(spark, sf_dir):
    from kindred.operators.extract import ats_record

    years = F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("string")).otherwise(F.lit('"many"'))
    body = F.concat(F.lit('{"cand_full_name": "'), F.col("c_name"), F.lit('", "email_addr": "c'), F.col("c_custkey").cast("string"), F.lit('@x.org", "company_name": "'), F.col("c_mktsegment"), F.lit('", "years_of_experience": '), years, F.when(F.col("c_custkey") % 5 == 0, "").otherwise("}"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", ats_record(body).alias("r"))
    return rows.select("c_custkey", "r.fields.name", "r.fields.email", "r.fields.current_company", "r.fields.years_experience", "r.raw_confidence")


@query("SELECT p_partkey, CASE WHEN p_size%3=0 THEN 'JavaScript' WHEN p_size%3=1 THEN 'Spring Boot' ELSE concat('part ',p_size) END AS skill, cast(CASE WHEN p_size%3=2 THEN 0.4 ELSE 1.0 END AS double) AS confidence FROM part")
def skill_exact(spark, sf_dir):
    k = F.col("p_size") % 3
    raw = F.when(k == 0, " javascript").when(k == 1, "SPRING boot").otherwise(F.concat(F.lit("part "), F.col("p_size").cast("string")))
    known = spark.createDataFrame([(t.lower(), t) for t in fuzzy.TAXONOMY], "low string, known string")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.trim(raw).alias("raw")).withColumn("low", F.lower("raw"))
    out = rows.join(F.broadcast(known), "low", "left")  # the taxonomy: a fixed few names
    return out.select("p_partkey", F.coalesce("known", "raw").alias("skill"), F.when(F.col("known").isNotNull(), 1.0).otherwise(0.4).alias("confidence"))


@query()
def skill_fuzzy(spark, sf_dir):
    """Distinct words of part names against the taxonomy, by approximate search."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", fuzzy.skill(F.col("word")).alias("s")).select("word", "s.name", "s.confidence")


@query(f"WITH {RECS} SELECT rec_ord, full_name, coalesce(email,'') AS emails, coalesce(phone,'') AS phones FROM recs")
def normalize_record(spark, sf_dir):
    raw = records(spark, sf_dir)
    shouted = raw.select("rec_ord", F.concat(F.lit(" "), "full_name", F.lit(" ")).alias("full_name"), F.transform("emails", lambda e: F.concat(F.lit("  "), F.upper(e))).alias("emails"), F.transform("phones", lambda p: F.regexp_replace(p, r"^\+1(...)(...)", "($1) $2-")).alias("phones"))
    return shouted.select("rec_ord", scalars.trimmed(F.col("full_name")).alias("full_name"), joined(scalars.email_list(F.col("emails"))).alias("emails"), joined(scalars.phone_list(F.col("phones"))).alias("phones"))


# ---------------------------------------------------------------- matching and clusters

KEYED = "WITH {0} SELECT later, earlier FROM (SELECT rec_ord later, lag(rec_ord) OVER (PARTITION BY {1} ORDER BY rec_ord) earlier FROM recs WHERE {1} IS NOT NULL) x WHERE earlier IS NOT NULL"


@query(KEYED.format(RECS, "email"))
def match_links_email(spark, sf_dir):
    return cluster.key_links(records(spark, sf_dir), "emails")


@query(KEYED.format(RECS, "phone"))
def match_links_phone(spark, sf_dir):
    return cluster.key_links(records(spark, sf_dir), "phones")


@query(f"WITH RECURSIVE {RECS}, {LINKS} SELECT later, earlier FROM nameedges")
def match_links_name(spark, sf_dir):
    return cluster.whole_overlap_pairs(records(spark, sf_dir))


@query(f"WITH RECURSIVE {RECS}, {LINKS}, r AS (SELECT x.rec_ord later, y.rec_ord earlier, x.w a, y.w b FROM words x JOIN words y ON x.rec_ord>y.rec_ord), o AS (SELECT later, earlier, list_sum(list_transform(a, lambda w: CASE WHEN list_contains(b,w) THEN 1.0 WHEN len(list_filter(b, lambda v: (length(w)=1 AND starts_with(v,w)) OR (length(v)=1 AND starts_with(w,v))))>0 THEN 0.5 ELSE 0.0 END))::DOUBLE/least(len(a),len(b)) AS ratio FROM r) SELECT * FROM o WHERE ratio>=0.75")
def match_overlap_ratio(spark, sf_dir):
    people = cluster.named(records(spark, sf_dir)).select("rec_ord", "words")
    names = cluster.overlapping_names(people.select("words").distinct())
    own = lambda place: people.select(F.col("words").alias(place), F.col("rec_ord").alias(f"{place}_ord"))
    both = names.join(cluster.merging(own("later")), "later").join(cluster.merging(own("earlier")), "earlier").where("later_ord > earlier_ord")
    return both.select(F.col("later_ord").alias("later"), F.col("earlier_ord").alias("earlier"), "ratio")


@query("SELECT a.c_custkey AS a, b.c_custkey AS b, a.c_mktsegment=b.c_mktsegment AS company, a.c_nationkey=b.c_nationkey AS location, (a.c_mktsegment=b.c_mktsegment AND a.c_nationkey=b.c_nationkey) AS skills FROM customer a JOIN customer b ON b.c_custkey=a.c_custkey+1")
def shared_signals(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    skill = lambda x: F.struct(x.alias("name"))
    own = c.select("c_custkey", F.array(F.concat(F.lit(" "), F.upper("c_mktsegment"))).alias("companies"), F.struct(F.lit(None).cast("string").alias("city"), F.lit("").alias("region"), F.col("c_nationkey").cast("string").alias("country")).alias("location"),
                   F.array(skill(F.col("c_mktsegment")), skill(F.col("c_nationkey").cast("string")), skill(F.lit("x"))).alias("skills"))
    a, b = own.select(*[F.col(x).alias(f"{x}_a") for x in own.columns]), own.select(*[F.col(x).alias(f"{x}_b") for x in own.columns])
    both = a.join(b, F.col("c_custkey_b") == F.col("c_custkey_a") + 1)
    return both.select(F.col("c_custkey_a").alias("a"), F.col("c_custkey_b").alias("b"), cluster.shared_company(F.col("companies_a"), F.col("companies_b")).alias("company"), cluster.shared_location(F.col("location_a"), F.col("location_b")).alias("location"), cluster.shared_skills(F.col("skills_a"), F.col("skills_b")).alias("skills"))


@query(GROUPED + "SELECT rec_ord, group_id FROM grp")
def cluster_greedy(spark, sf_dir):
    return grouped(spark, sf_dir).select("rec_ord", "group_id")


ROOTS_SQL = """walk(id,root) AS (SELECT rec_ord, rec_ord FROM recs WHERE rec_ord NOT IN (SELECT later FROM edges)
   UNION SELECT e.later, walk.root FROM walk JOIN edges e ON e.earlier=walk.id) SELECT id AS rec_ord, min(root) AS group_id FROM walk GROUP BY id"""


@query(f"""WITH RECURSIVE recs AS (SELECT c_custkey rec_ord, CASE WHEN c_custkey%5=2 THEN 'office@example.com' ELSE concat('desk',(c_custkey*7)%1000//4,'@example.com') END email, CASE WHEN c_custkey%3=0 THEN '+14155550100' WHEN c_custkey%4=1 THEN concat('+1415556',lpad(cast(c_custkey%400 AS varchar),4,'0')) END phone FROM customer),
 edges AS (SELECT rec_ord later, lag(rec_ord) OVER (PARTITION BY email ORDER BY rec_ord) earlier FROM recs UNION ALL SELECT rec_ord, lag(rec_ord) OVER (PARTITION BY phone ORDER BY rec_ord) FROM recs WHERE phone IS NOT NULL),
 edges2 AS (SELECT * FROM edges WHERE earlier IS NOT NULL), {ROOTS_SQL.replace("edges", "edges2")}""")
def cluster_hot_keys(spark, sf_dir):
    """Customers behind one switchboard (a third of them) and one mailbox (a fifth), which overlap; the others share desks and lines."""
    k = F.col("c_custkey")
    mail = F.when(k % 5 == 2, "office@example.com").otherwise(F.concat(F.lit("desk"), F.floor((k * 7) % 1000 / 4).cast("string"), F.lit("@example.com")))
    tel = F.when(k % 3 == 0, "+14155550100").when(k % 4 == 1, F.concat(F.lit("+1415556"), F.lpad((k % 400).cast("string"), 4, "0")))
    recs = table(spark, sf_dir, "customer").select(k.cast("long").alias("rec_ord"), F.lit(None).cast("string").alias("full_name"), F.array(mail).alias("emails"), F.array_compact(F.array(tel)).alias("phones"))
    return cluster.cluster(recs).select("rec_ord", "group_id")


@query(f"""WITH RECURSIVE recs AS (SELECT c_custkey rec_ord, CASE WHEN c_custkey%4=0 THEN ['maria','lopez'] WHEN c_custkey%4=1 THEN ['maria',concat('n',c_custkey%9),'lopez'] WHEN c_custkey%4=2 THEN ['lopez',concat('n',c_custkey%9)] ELSE ['unit','unit',concat('n',c_custkey%90)] END w FROM customer),
 c AS (SELECT DISTINCT list_sort(w) w FROM recs), m AS (SELECT a.w a, b.w b FROM c a, c b WHERE len(list_filter(a.w, lambda x: list_contains(b.w,x)))=least(len(a.w),len(b.w))),
 h AS (SELECT rec_ord, list_sort(w) w FROM recs), asks AS (SELECT h.rec_ord, m.b FROM h JOIN m ON m.a=h.w), edges AS (SELECT x.rec_ord later, h.rec_ord earlier FROM asks x ASOF JOIN h ON h.w=x.b AND x.rec_ord>h.rec_ord), {ROOTS_SQL}""")
def cluster_hot_names(spark, sf_dir):
    """Customers of which a quarter have one name, others longer and shorter forms of it, or names with a repeated word."""
    k = F.col("c_custkey")
    few, many = F.concat(F.lit("N"), (k % 9).cast("string")), F.concat(F.lit("N"), (k % 90).cast("string"))
    name = F.when(k % 4 == 0, "Lopez, Maria").when(k % 4 == 1, F.concat(F.lit("Maria "), few, F.lit(" Lopez"))).when(k % 4 == 2, F.concat(few, F.lit(" LOPEZ"))).otherwise(F.concat(F.lit("Unit unit "), many))
    recs = table(spark, sf_dir, "customer").select(k.cast("long").alias("rec_ord"), name.alias("full_name"))
    return cluster.roots(recs, cluster.whole_overlap_links(recs))


@query()
def cluster_close_names(spark, sf_dir):
    """Customers and suppliers by misspelt names with a nation or segment in common."""
    names = F.array(*map(F.lit, ("Katherina", "Bartholomew", "Wilhelmine", "Maximilian", "Josephine", "Alexander Ng", "Ng", "J. Okonkwo", "John Okonkwo")))
    spell = lambda k: F.regexp_replace(F.get(names, (k % 9).cast("int")), F.substring(F.lit("abcdefghiklmnoprstuvwx"), ((k * 7) % 22 + 1).cast("int"), F.lit(1)), F.when(k % 3 == 0, "z").otherwise(""))
    person = lambda df, k, ord_, nation, segment: df.select((k * 2 + ord_).cast("long").alias("rec_ord"), spell(k).alias("full_name"), F.array_compact(F.array(segment)).alias("companies"), F.struct(F.lit(None).cast("string").alias("city"), F.lit("").alias("region"), nation.cast("string").alias("country")).alias("location"), F.lit(None).cast("array<struct<name:string,confidence:double>>").alias("skills"))
    c = person(table(spark, sf_dir, "customer"), F.col("c_custkey"), 0, F.col("c_nationkey"), F.when(F.col("c_custkey") % 4 == 0, F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 13).cast("string"))))
    s = person(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), 1, F.col("s_nationkey"), F.lit(None).cast("string"))
    recs = c.unionByName(s)
    return cluster.roots(recs, cluster.close_name_links(recs))


# ---------------------------------------------------------------- merging

PRIO = "CASE source_type WHEN 'ats_json' THEN 0 WHEN 'recruiter_csv' THEN 1 WHEN 'github_api' THEN 3 ELSE 99 END"
RANKED = f"rk AS (SELECT *, row_number() OVER w place, first_value(full_name) OVER w winner, count(*) OVER (PARTITION BY group_id) n FROM g WHERE full_name IS NOT NULL WINDOW w AS (PARTITION BY group_id ORDER BY raw_confidence DESC, {PRIO}, rec_ord)), ag AS (SELECT *, sum(CASE WHEN full_name=winner THEN 1 ELSE 0 END) OVER (PARTITION BY group_id) agree, CASE WHEN n=1 THEN 'direct' WHEN 2*sum(CASE WHEN full_name=winner THEN 1 ELSE 0 END) OVER (PARTITION BY group_id)>n THEN 'merged_majority' ELSE 'merged_priority' END AS method FROM rk)"


@query(GROUPED + f", {RANKED} SELECT group_id, full_name AS value, method FROM ag WHERE place=1")
def resolve_scalar(spark, sf_dir):
    return merge.resolved(merge.scalar_values(grouped(spark, sf_dir), ("full_name",))).select("group_id", "value", "method")


@query(GROUPED + f", {RANKED} SELECT group_id, source_id AS source, method, place AS seq FROM ag WHERE place=1 OR full_name<>winner")
def provenance_scalar(spark, sf_dir):
    return merge.scalar_provenance(merge.scalar_values(grouped(spark, sf_dir), ("full_name",))).select("group_id", "source", "method", "seq")


@query(GROUPED + "SELECT group_id, md5(coalesce(first(email ORDER BY rec_ord) FILTER (WHERE email IS NOT NULL), first(full_name ORDER BY rec_ord) FILTER (WHERE full_name IS NOT NULL), 'unknown')) AS candidate_id FROM g GROUP BY group_id")
def candidate_id(spark, sf_dir):
    return merge.candidate_ids(grouped(spark, sf_dir))


UNION_SQL = GROUPED + ", v AS (SELECT group_id, {0} v, min(rec_ord) o FROM g WHERE {0} IS NOT NULL GROUP BY group_id, {0}) SELECT group_id, string_agg(v,'|' ORDER BY o) AS {0}s FROM v GROUP BY group_id"


@query(UNION_SQL.format("email"))
def union_emails(spark, sf_dir):
    return merge.listed(merge.occurrences(grouped(spark, sf_dir), "emails"), "emails").select("group_id", joined("emails").alias("emails"))


@query(UNION_SQL.format("phone"))
def union_phones(spark, sf_dir):
    return merge.listed(merge.occurrences(grouped(spark, sf_dir), "phones"), "phones").select("group_id", joined("phones").alias("phones"))


@query(GROUPED + ", v AS (SELECT group_id, email, row_number() OVER (PARTITION BY group_id ORDER BY min(rec_ord))-1 idx FROM g WHERE email IS NOT NULL GROUP BY group_id, email) SELECT g.group_id, concat('emails[',v.idx,']') AS field, g.source_id AS source, 'direct' AS method FROM g JOIN v ON v.group_id=g.group_id AND v.email=g.email")
def provenance_list(spark, sf_dir):
    rows = merge.list_provenance(merge.occurrences(grouped(spark, sf_dir), "emails"), "emails")
    return rows.select("group_id", merge.field_path(F.col("field"), F.col("idx")).alias("field"), "source", "method")


def merged_skills_sql(group: str) -> str:
    return f"WITH e AS (SELECT {group} AS gid, event_type AS name, 'events:'||cast(user_id//50 AS varchar) AS source, event_id, CASE WHEN value>100 THEN 0.9 ELSE 0.7 END AS conf FROM events), a AS (SELECT gid, name, list(conf ORDER BY event_id) c, count(DISTINCT source) s FROM e GROUP BY gid, name), m AS (SELECT gid, name, s, list_reduce(list_prepend(0.0::DOUBLE, list_transform(c, lambda x: x::DOUBLE)), lambda x, y: x+y)/len(c)+CASE WHEN s>=2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END x FROM a) SELECT gid AS group_id, name AS skill, least(1.0::DOUBLE, " + fixed2_sql("x") + ") AS confidence, s AS n_sources FROM m"


def event_skills(spark: SparkSession, sf_dir: str, group: Column) -> DataFrame:
    e = table(spark, sf_dir, "events")
    found = e.select(group.alias("group_id"), F.col("event_id").alias("rec_ord"), F.lit(0).alias("pos"), F.concat(F.lit("events:"), F.floor(F.col("user_id") / 50).cast("string")).alias("source_id"), F.col("event_type").alias("value"), F.when(F.col("value") > 100, 0.9).otherwise(0.7).alias("confidence"))
    return merge.merged_skills(found).select("group_id", F.col("value").alias("skill"), "confidence", F.size("sources").cast("long").alias("n_sources"))


@query(merged_skills_sql("user_id%50"))
def merge_skills(spark, sf_dir):
    return event_skills(spark, sf_dir, F.col("user_id") % 50)


@query(merged_skills_sql("0::BIGINT"))
def merge_skills_of_one(spark, sf_dir):
    """One group that holds all events."""
    return event_skills(spark, sf_dir, F.lit(0).cast("long"))


@query("WITH j AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey%2=0 THEN concat(' ',lower(o_orderpriority)) ELSE o_orderpriority END company, o_orderstatus title, strftime(o_orderdate,'%Y-%m') m FROM orders), k AS (SELECT o_custkey, lower(trim(company)) k1, lower(trim(title)) k2, min(m) s, max(m) e, first(company ORDER BY o_orderkey) company, first(title ORDER BY o_orderkey) title, min(o_orderkey) f, count(*) n FROM j GROUP BY 1,2,3) SELECT o_custkey AS group_id, row_number() OVER (PARTITION BY o_custkey ORDER BY f)-1 AS idx, company, title, s AS \"start\", e AS \"end\", n AS n_sources FROM k")
def merge_experience(spark, sf_dir):
    m = F.date_format("o_orderdate", "yyyy-MM")
    shout = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.lower("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("rec_ord"), F.lit(0).alias("pos"), F.col("o_orderkey").cast("string").alias("source_id"), shout.alias("company"), F.col("o_orderstatus").alias("title"), m.alias("start"), m.alias("end"), F.lit(None).cast("string").alias("summary"))
    return merge.merged_experience(jobs).select("group_id", F.col("idx").cast("long").alias("idx"), "company", "title", "start", "end", F.size("sources").cast("long").alias("n_sources"))


@query("WITH j AS (SELECT s_nationkey g, s_suppkey o, concat('School ',s_suppkey%3) i, concat('Deg ',s_suppkey%2) d, CASE WHEN s_suppkey%4=0 THEN NULL ELSE concat('F',s_suppkey) END f, CASE WHEN s_suppkey%5=0 THEN NULL ELSE 2000+s_suppkey%20 END y FROM supplier), k AS (SELECT g, i, d, min(o) m, first(f ORDER BY o) FILTER (WHERE f IS NOT NULL) f, first(y ORDER BY o) FILTER (WHERE y IS NOT NULL) y FROM j GROUP BY g,i,d) SELECT g AS group_id, row_number() OVER (PARTITION BY g ORDER BY m)-1 AS idx, i AS institution, d AS degree, f AS field, cast(y AS integer) AS end_year FROM k")
def merge_education(spark, sf_dir):
    s = F.col("s_suppkey")
    t = lambda c: c.cast("string")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group_id"), s.alias("rec_ord"), F.lit(0).alias("pos"), t(s).alias("source_id"), F.concat(F.lit("School "), t(s % 3)).alias("institution"), F.concat(F.lit("Deg "), t(s % 2)).alias("degree"), F.when(s % 4 != 0, F.concat(F.lit("F"), t(s))).alias("field"), F.when(s % 5 != 0, (2000 + s % 20).cast("int")).alias("end_year"))
    return merge.merged_education(rows).select("group_id", F.col("idx").cast("long").alias("idx"), "institution", "degree", "field", "end_year")


CONF = f", p AS (SELECT group_id, source_id, min(rec_ord) o, first(raw_confidence) c FROM g WHERE {{0}} IS NOT NULL GROUP BY group_id, source_id), m AS (SELECT group_id, list(c ORDER BY o) l FROM p GROUP BY group_id) SELECT group_id, least(1.0::DOUBLE, {fixed2_sql('list_reduce(list_prepend(0.0::DOUBLE, l), lambda x, y: x+y)/len(l)+CASE WHEN len(l)>=2 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END')}) AS confidence FROM m"


@query(GROUPED + CONF.format("email"))
def field_confidence(spark, sf_dir):
    recs = grouped(spark, sf_dir)
    told = merge.list_provenance(merge.occurrences(recs, "emails"), "emails")
    return confidence.field_confidences(told, confidence.source_confidence(recs)).select("group_id", "confidence")


@query()
def canonical_profiles(spark, sf_dir):
    """Whole canonical profiles with their confidence, nested values as JSON."""
    out = canonical(spark, sf_dir)
    return out.select("group_id", "candidate_id", "full_name", "headline", "overall_confidence", *[F.to_json(c).alias(c) for c in ("emails", "phones", "skills", "experience", "education", "provenance")], F.to_json("location").alias("location"), F.to_json("links").alias("links"))


@query(GROUPED + ", s AS (SELECT group_id, count(*) n, count(email) e, count(phone) p, count(full_name) f FROM g GROUP BY group_id) SELECT group_id, (e>0 OR p>0) AS reachable, f>0 AS named, cast(CASE WHEN f>0 AND (e>0 OR p>0) THEN 1.0 WHEN f>0 OR e>0 OR p>0 THEN 0.5 ELSE 0.0 END AS double) AS penalty FROM s")
def required_categories(spark, sf_dir):
    recs = grouped(spark, sf_dir)
    values = merge.resolved(merge.scalar_values(recs, ("full_name",))).select("group_id", F.col("value").alias("full_name"))
    base = recs.groupBy("group_id").agg(F.max(F.size("emails")).alias("e"), F.max(F.size("phones")).alias("p"))
    out = base.join(values, "group_id", "left").withColumn("full_name", F.coalesce("full_name", F.lit(merge.UNKNOWN)))
    reach, name = (F.col("e") > 0) | (F.col("p") > 0), confidence.populated("full_name")
    return out.select("group_id", reach.alias("reachable"), name.alias("named"), ((reach.cast("double") + name.cast("double")) / 2).alias("penalty"))


@query(GROUPED + f", {RANKED}, f AS (SELECT group_id, full_name FROM ag WHERE place=1), ids AS (SELECT DISTINCT group_id FROM g) SELECT ids.group_id, CASE WHEN f.full_name IS NULL THEN 'Unknown Candidate' ELSE f.full_name END AS full_name, 0 AS n_faults FROM ids LEFT JOIN f USING(group_id)")
def validate_canonical(spark, sf_dir):
    out = project.canonical_faults(merge.profiles(full_records(spark, sf_dir)))
    return out.select("group_id", "full_name", F.size("faults").alias("n_faults"))


RULES = {"candidate_id": 11, "full_name": 13, "emails": 5, "location.country": 7, "links": 17, "skills": 3, "experience": 19, "provenance": 23, "overall_confidence": 29}


@query("SELECT c_custkey AS group_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN c_custkey%{n}=0 THEN '{rule}' END" for rule, n in RULES.items()) + "], lambda x: x IS NOT NULL), ',') AS faults FROM customer")
def validate_rules(spark, sf_dir):
    """Profiles of which every rule refuses some."""
    k, none = F.col("group_id"), F.lit(None).cast("string")
    bad = {rule: k % n == 0 for rule, n in RULES.items()}
    link = lambda c: F.struct(c.alias("linkedin"), none.alias("github"), none.alias("portfolio"), F.array(F.lit("https://x.org/a")).alias("other"))
    job = lambda c: F.array(F.struct(c.alias("start"), none.alias("end")))
    out = simple_profiles(spark, sf_dir).select(
        "group_id", F.when(~bad["candidate_id"], F.col("candidate_id")).alias("candidate_id"), F.when(~bad["full_name"], F.col("full_name")).alias("full_name"), F.when(bad["emails"], F.array(F.lit("no address"))).otherwise(F.array(F.lit("a@x.org"))).alias("emails"),
        F.struct(F.when(bad["location.country"], "USA").otherwise("US").alias("country")).alias("location"), link(F.when(bad["links"], "no link").otherwise("https://x.org")).alias("links"),
        F.array(F.struct(F.when(bad["skills"], 1.5).otherwise(1.0).alias("confidence"))).alias("skills"), job(F.when(bad["experience"], "May 2020").otherwise("2020-05")).alias("experience"),
        F.when(bad["provenance"], F.array().cast("array<struct<method:string>>")).otherwise(F.col("provenance")).alias("provenance"), F.when(bad["overall_confidence"], -0.1).otherwise(0.5).alias("overall_confidence"),
    )
    return project.canonical_faults(out).select("group_id", F.array_join("faults", ",").alias("faults"))


def _overall_sql() -> str:
    """The weighted mean, added up in the same order."""
    there = {name: f"c_custkey%{k + 2}<>0" for k, name in enumerate(confidence.WEIGHTS)}
    total, weight = "0e0", "0e0"
    for k, (name, w) in enumerate(confidence.WEIGHTS.items()):
        total = f"({total}+CASE WHEN {there[name]} THEN ((c_custkey*{k + 3}%10)/10e0)*{w}::DOUBLE ELSE 0e0 END)"
        weight = f"({weight}+CASE WHEN {there[name]} THEN {w}::DOUBLE ELSE 0e0 END)"
    share = f"((CASE WHEN {there['full_name']} THEN 1e0 ELSE 0e0 END+CASE WHEN {there['emails']} OR {there['phones']} THEN 1e0 ELSE 0e0 END)/2e0)"
    return f"WITH t AS (SELECT c_custkey, CASE WHEN {weight}>0 THEN {total}/{weight} ELSE 0e0 END*{share} AS x FROM customer) SELECT c_custkey AS group_id, {fixed2_sql('x')} AS overall_confidence FROM t"


@query(_overall_sql())
def overall_confidence(spark, sf_dir):
    """All ten fields, each there or not, with confidences of their own."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    kinds = {"full_name": F.lit("A"), "location": F.struct(none.alias("city")), "headline": F.lit("h"), "years_experience": F.lit(1.0)}
    columns = []
    for n, name in enumerate(confidence.WEIGHTS):
        there = k % (n + 2) != 0
        if name == "links":
            own = F.struct(F.when(there, "https://x.org").alias("linkedin"), none.alias("github"), none.alias("portfolio"), F.array().cast("array<string>").alias("other"))
        elif name in kinds:
            own = F.when(there, kinds[name])
        else:
            own = F.when(there, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
        columns.append(own.alias(name))
    sure = {name: (k * (n + 3) % 10) / F.lit(10.0) for n, name in enumerate(confidence.WEIGHTS)}
    return table(spark, sf_dir, "customer").select("c_custkey", *columns).select(k.alias("group_id"), confidence.overall(sure).alias("overall_confidence"))


# ---------------------------------------------------------------- projection

def simple_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles made straight from customers, for projection queries."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    n = F.lpad((F.lit(4155550000) + k).cast("string"), 10, "0")  # (415) 555-0000 and on: ten digits for every key
    return c.select(
        k.alias("group_id"), F.concat(F.lit("id"), k.cast("string")).alias("candidate_id"), F.col("c_name").alias("full_name"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), k.cast("string"), F.lit("@x.org")))).alias("emails"),
        F.array(F.concat(F.lit("("), F.substring(n, 1, 3), F.lit(") "), F.substring(n, 4, 3), F.lit("-"), F.substring(n, 7, 4))).alias("phones"),
        F.struct(none.alias("city"), F.col("c_mktsegment").alias("region"), F.lit("US").alias("country")).alias("location"), F.when(k % 2 == 0, F.col("c_acctbal")).alias("years_experience"),
        F.array(F.struct(F.lit("Go").alias("name"), F.lit(0.5).alias("confidence"), F.array(F.lit("s")).alias("sources"))).alias("skills"),
        F.array(F.struct(F.lit("direct").alias("method"))).alias("provenance"), F.lit(0.75).alias("overall_confidence"),
    )


def _config(*fields: OutputField, **more) -> OutputConfig:
    return OutputConfig(tuple(fields), more.get("confidence", True), more.get("provenance", False), more.get("missing", "null"))


@query("SELECT c_custkey AS group_id, c_name AS label, CASE WHEN c_custkey%3<>0 THEN concat('c',c_custkey,'@x.org') END AS mail, concat('+1',cast(4155550000+c_custkey AS varchar)) AS phone, c_mktsegment AS region, cast(0.75 AS double) AS overall_confidence, CASE WHEN c_custkey%3=0 THEN 1 ELSE 0 END AS n_warnings FROM customer")
def project_nested(spark, sf_dir):
    config = _config(OutputField("label", "full_name", "string", True), OutputField("reach.mail", "emails[0]", "string", True), OutputField("reach.phone", "phones[0]", "string", False, "E164"), OutputField("region", "location.region", "string"))
    out = project.projected(simple_profiles(spark, sf_dir), config, ("group_id",))
    return out.select("group_id", "label", "reach.mail", "reach.phone", "region", "overall_confidence", F.size("warnings").alias("n_warnings"))


@query("SELECT c_custkey AS group_id, CASE WHEN c_custkey%3<>0 THEN 1 ELSE 0 END AS n_emails, c_custkey%2=0 AND c_acctbal<>0 AS has_years, c_name AS names, CASE WHEN c_custkey%2=0 THEN c_acctbal END AS years FROM customer")
def coerce_types(spark, sf_dir):
    config = _config(OutputField("n", "emails.length", "number"), OutputField("has_years", "years_experience", "boolean"), OutputField("names", "full_name", "string[]"), OutputField("years", "years_experience", "number"))
    out = project.projected(simple_profiles(spark, sf_dir), config, ("group_id",))
    return out.select("group_id", F.col("n").cast("int").alias("n_emails"), F.coalesce("has_years", F.lit(False)).alias("has_years"), joined("names").alias("names"), "years")


@query("SELECT c_custkey AS group_id, CASE WHEN c_custkey%3<>0 THEN concat('{\"a\":\"c',c_custkey,'@x.org\",\"s\":[{\"name\":\"Go\",\"sources\":[\"s\"]}]}') ELSE '{\"s\":[{\"name\":\"Go\",\"sources\":[\"s\"]}]}' END AS json FROM customer")
def project_omit(spark, sf_dir):
    config = _config(OutputField("a", "emails[0]", "string"), OutputField("s", "skills", "object"), confidence=False, missing="omit")
    out = project.projected(simple_profiles(spark, sf_dir), config, ("group_id",))
    return out.select("group_id", F.to_json(F.struct("a", "s")).alias("json"))


@query("SELECT count(*) FILTER (WHERE c_custkey%3<>0) AS accepted, count(*) FILTER (WHERE c_custkey%3=0) AS refused FROM customer")
def project_required(spark, sf_dir):
    config = _config(OutputField("email", "emails[0]", "string", True))
    out = project.projected(simple_profiles(spark, sf_dir), config, ("group_id",))
    return out.agg(F.count_if(F.size("warnings") == 0).alias("accepted"), F.count_if(F.size("warnings") > 0).alias("refused"))


@query("SELECT c_custkey AS group_id, 'projection' AS stage, 'Required field ''email'' is missing' AS message FROM customer WHERE c_custkey%3=0")
def warnings_feed(spark, sf_dir):
    out = project.projected(simple_profiles(spark, sf_dir), _config(OutputField("email", "emails[0]", "string", True)), ("group_id",))
    return out.select("group_id", F.lit("projection").alias("stage"), F.explode("warnings").alias("message"))


# ---------------------------------------------------------------- services and presentation

@query("WITH c AS (SELECT user_id, event_type AS language, count(*) n, min(event_id) f FROM events GROUP BY 1,2) SELECT user_id, string_agg(language,'|' ORDER BY n DESC, f) AS languages FROM c GROUP BY user_id")
def github_language_rank(spark, sf_dir):
    from kindred.operators.extract import languages

    repos = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("pos"), F.col("event_type").alias("language"))
    return languages(repos).select(F.col("user").alias("user_id"), joined("languages").alias("languages"))


@query("SELECT o_custkey AS run_id, last(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS status, max(o_orderdate) AS at FROM orders GROUP BY o_custkey")
def runs_latest(spark, sf_dir):
    from kindred.plans.store import current_runs

    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return current_runs(events).select("run_id", "status", "at")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount*10>=0.85 THEN 'REFINED' WHEN l_discount*10>=0.5 THEN 'STABLE' ELSE 'UNSTABLE' END AS tier, CASE WHEN l_discount*10>=0.8 THEN 'green' WHEN l_discount*10>=0.5 THEN 'orange' ELSE 'red' END AS badge, 38+CASE WHEN l_discount=0 THEN 0.5 ELSE l_discount END*140 AS hue, cast(floor(l_discount*100+0.5) AS integer) AS percent, strftime(l_shipdate,'%b %Y') AS month FROM lineitem")
def confidence_tier(spark, sf_dir):
    c = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", present.tier(c).alias("tier"), present.badge(c).alias("badge"), present.skill_hue(F.col("l_discount")).alias("hue"), present.percent(F.col("l_discount")).alias("percent"), present.month_label(F.date_format("l_shipdate", "yyyy-MM")).alias("month"))


@query(f"WITH {RECS} SELECT rec_ord, CASE source_type WHEN 'ats_json' THEN 'ats' WHEN 'recruiter_csv' THEN 'csv' ELSE 'github' END AS family, upper(right(source_id,6)) AS label FROM recs")
def source_family(spark, sf_dir):
    return records(spark, sf_dir).select("rec_ord", present.source_family(F.col("source_id")).alias("family"), present.run_label(F.col("source_id")).alias("label"))


@query("SELECT doc_id, CASE WHEN length(text)>150 THEN concat(substr(text,1,150),'...') ELSE text END AS summary FROM documents")
def summary_trunc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", present.shortened(F.col("text")).alias("summary"))


# ---------------------------------------------------------------- shapes, faults and whole runs

#: Faults of outputs by the path that has them, and which customers' outputs have them; one in a record that isn't there hides its members'.
SHAPE_FAULTS = {
    "label is missing": "c_custkey%11=0", "reach isn't a record": "c_custkey%23=0", "reach.mail isn't a text": "c_custkey%7=0 AND c_custkey%23<>0", "reach.years isn't a number": "c_custkey%3=0 AND c_custkey%23<>0",
    "reach.years is missing": "c_custkey%13=0 AND c_custkey%3<>0 AND c_custkey%23<>0", "tags isn't a list": "c_custkey%29=0", "tags[1] is missing": "c_custkey%5=0 AND c_custkey%29<>0", "data isn't a record or a list": "c_custkey%2=0",
    "overall_confidence isn't from 0 to 1": "c_custkey%17=0", "provenance[0].method is missing": "c_custkey%19=0",
}
CUSTOMER_SHAPE = OutputConfig((OutputField("label", "full_name", "string", True), OutputField("reach.mail", "emails[0]", "string"), OutputField("reach.years", "years_experience", "number", True), OutputField("tags", "emails", "string[]", True), OutputField("data", "skills", "object")))


@query("SELECT c_custkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{fault.replace(chr(39), chr(39) * 2)}' END" for fault, when in SHAPE_FAULTS.items()) + "], lambda x: x IS NOT NULL), '; ') AS faults FROM customer")
def shape_faults(spark, sf_dir):
    """Outputs as JSON texts, of which every kind of place is against the declared shape in some."""
    from kindred.plans.shape import json_faults

    k, text_ = F.col("c_custkey"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    years = F.when(k % 3 == 0, ',"years":"many"').when(k % 13 == 0, "").otherwise(',"years":2.5')
    reach = F.when(k % 23 == 0, '"none"').otherwise(F.concat(F.lit('{"mail":'), F.when(k % 7 == 0, "5").otherwise(text_(F.concat(F.lit("c"), k.cast("string"), F.lit("@x.org")))), years, F.lit("}")))
    parts = {
        "label": F.when(k % 11 == 0, "null").otherwise(text_(F.col("c_name"))), "reach": reach, "tags": F.when(k % 29 == 0, '"a"').when(k % 5 == 0, '["a",null]').otherwise('["a","b"]'),
        "data": F.when(k % 2 == 0, "1").when(k % 3 == 0, "[1]").otherwise('{"a":1}'), "overall_confidence": F.when(k % 17 == 0, "1.5").otherwise("0.5"),
        "provenance": F.when(k % 19 == 0, '[{"field":"a","source":"b"}]').otherwise('[{"field":"a","source":"b","method":"direct"}]'),
    }
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), c) for n, c in parts.items()]), F.lit("}"))
    faults = F.transform(json_faults(body, CUSTOMER_SHAPE), lambda f: F.concat(f["path"], F.lit(" "), f["fault"]))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(faults, "; ").alias("faults"))


def ats_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of each customer: every eleventh is no JSON, every fifth has null for a job, every seventh an email without a domain's end, every third tells no years."""
    k = F.col("c_custkey")
    job = F.concat(F.lit('{"firm":"F'), k.cast("string"), F.lit('","role":"R","from":"May 2020","to":"Jun 2021"}'))
    body = F.concat(F.lit('{"cand_full_name":"P'), F.md5(k.cast("string")), F.lit('","email_addr":"p'), k.cast("string"), F.when(k % 7 == 0, '@x"').otherwise('@x.org"'), F.when(k % 3 == 0, "").otherwise(',"years_of_experience":4'), F.lit(',"jobs":['), F.when(k % 5 == 0, "null,").otherwise(""), job, F.lit("]}"))
    content = F.when(k % 11 == 0, F.lit("{broken")).otherwise(body).cast("binary")
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(k.cast("int").alias("source_pos"), F.concat(k.cast("string"), F.lit(".json")).alias("filename"), F.lit(None).cast("string").alias("url"), content.alias("content"))


@query("""WITH c AS (SELECT c_custkey k, c_custkey%11=0 OR c_custkey%5=0 broken, c_custkey%7=0 faulty FROM customer)
 SELECT 'extract' AS stage, concat(k,'.json') AS subject, 'Nothing could be extracted' AS message FROM c WHERE broken
 UNION ALL SELECT 'validate', md5(concat('p',k,'@x')), 'Invalid profile: emails' FROM c WHERE NOT broken AND faulty
 UNION ALL SELECT 'validate', md5('unknown'), 'Invalid profile: provenance' FROM c WHERE broken
 UNION ALL SELECT 'project', cast(k*4294967296 AS varchar), 'Required field ''reach.years'' is missing' FROM c WHERE NOT broken AND NOT faulty AND k%3=0
 UNION ALL SELECT 'shape', cast(k*4294967296 AS varchar), 'Against the declared shape: reach.years is missing' FROM c WHERE NOT broken AND NOT faulty AND k%3=0""")
def run_warnings(spark, sf_dir):
    """The warnings of a whole run, from sources to outputs."""
    from kindred.plans.pipeline import run_pipeline

    return run_pipeline(spark, ats_sources(spark, sf_dir), CUSTOMER_SHAPE).warnings


@query("SELECT c_custkey, 'Ada Novak' AS hint_name, CASE WHEN c_custkey%3=0 THEN concat(CASE WHEN c_custkey%7=0 THEN 'A' ELSE 'a' END,c_custkey,CASE WHEN c_custkey%7=0 THEN '@X.org' ELSE '@x.org' END) WHEN c_custkey%3=1 THEN CASE WHEN c_custkey%7=0 THEN 'no address' ELSE concat('b',c_custkey,'@x.org') END END AS hint_email, CASE WHEN c_custkey%2=0 THEN CASE WHEN c_custkey%7=0 THEN '(415) 555-0100' ELSE '+14155550100' END END AS hint_phone, CASE WHEN c_custkey%4=0 THEN 'Oslo' WHEN c_custkey%4=1 THEN c_mktsegment END AS city, CASE WHEN c_custkey%4=0 THEN 'NO' WHEN c_custkey%4 IN (1,2) THEN 'GB' END AS country, CASE WHEN c_custkey%7=0 THEN 'experience' ELSE '' END AS faults, CASE WHEN c_custkey%7=0 THEN 'May 2020' ELSE '2020-05' END AS starts FROM customer")
def normalize_hints(spark, sf_dir):
    """Who a record may be of, with single emails and lists, and places told as a record or member by member. Records with null for a job are passed on as told."""
    from kindred.operators.normalize import normalized

    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    mail = lambda letter: F.concat(F.lit(letter), k.cast("string"), F.lit("@X.org"))
    place = F.when(k % 4 == 0, F.struct(F.lit("Oslo").alias("city"), none.alias("region"), F.lit("no").alias("country")))
    job = F.struct(F.lit("F").alias("company"), F.lit("R").alias("title"), F.lit("May 2020").alias("start"), none.alias("end"), none.alias("summary"))
    r = extract.record(
        F.lit(0.9), name=F.lit(" Ada Novak "), email=F.when(k % 3 == 0, mail("A")), emails=F.when(k % 3 == 1, F.array(F.lit("no address"), mail("B"), mail("C"))), phone=F.when(k % 2 == 0, "(415) 555-0100"),
        experience=F.array(F.when(k % 7 == 0, F.lit(None)).otherwise(job), job), location=place, city=F.when(k % 4 < 2, F.col("c_mktsegment")), country=F.when(k % 4 < 3, "United Kingdom"),
    )
    raw = table(spark, sf_dir, "customer").select(k.alias("rec_ord"), k.cast("string").alias("source_id"), F.lit("ats_json").alias("source_type"), r.alias("r")).select("rec_ord", "source_id", "source_type", "r.*")
    return normalized(raw).select(F.col("rec_ord").alias("c_custkey"), *[F.col(f"candidate_hint.{n}").alias(f"hint_{n}") for n in ("name", "email", "phone")], "location.city", "location.country", joined("faults").alias("faults"), joined(F.array_distinct("experience.start")).alias("starts"))


# ---------------------------------------------------------------- résumés

def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A résumé of each customer (c_custkey, text): three ways to tell a job, a second job for every other, four schools and degrees."""
    k = F.col("c_custkey")
    w = F.concat(F.lit("Z"), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    of = lambda pattern: F.replace(F.lit(pattern), F.lit("#"), w)
    jobs = ("Engineer # - Mill # | Jan 2015 - Dec 2018\n- Built #\n* Ran it", "Engineer # (2015-03 - Present)\nMill #, Oslo\n- Built #", "Engineer # at Mill #, 2016 - 2019\nRan #")
    schools = ("# University, 2019\nBachelor in Physics", "# Institute (2012 - 2016)\nM.Tech (Applied Maths)", "# College\nPhD, Botany\n2021", "# School, 2010\nDiploma in Welding, GPA 3")
    pick = lambda n, texts: F.element_at(F.array(*[of(t) for t in texts]), (k % n + 1).cast("int"))
    second = F.when(k % 2 == 0, of("\nClerk # | Shop # | Feb 2010 - Mar 2011")).otherwise("")
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.concat(of("Ana #\n#@x.org\n\nWork History\n"), pick(3, jobs), second, F.lit("\n\nEDUCATION\n"), pick(4, schools), F.lit("\n\nSKILLS\nGolang, SQL\n")).alias("text"))


_WORD = "WITH c AS (SELECT c_custkey, concat('Z', translate(cast(c_custkey AS varchar),'0123456789','abcdefghij')) w FROM customer) "


@query(_WORD + """SELECT c_custkey, 0 AS pos, concat('Mill ',w) AS company, concat('Engineer ',w) AS title, CASE c_custkey%3 WHEN 0 THEN '2015-01' WHEN 1 THEN '2015-03' ELSE '2016-01' END AS "start",
 CASE c_custkey%3 WHEN 0 THEN '2018-12' WHEN 1 THEN 'Present' ELSE '2019-01' END AS "end", CASE c_custkey%3 WHEN 0 THEN concat('Built ',w,' Ran it') WHEN 1 THEN concat('Built ',w) ELSE concat('Ran ',w) END AS summary FROM c
 UNION ALL SELECT c_custkey, 1, concat('Shop ',w), concat('Clerk ',w), '2010-02', '2011-03', NULL FROM c WHERE c_custkey%2=0""")
def resume_jobs(spark, sf_dir):
    from kindred.operators import resume

    return resumes(spark, sf_dir).select("c_custkey", F.posexplode(resume.experience(F.col("text"))).alias("pos", "job")).select("c_custkey", "pos", "job.*")


@query(_WORD + """SELECT c_custkey, concat('Ana ',w) AS name, lower(concat(w,'@x.org')) AS emails, 'Go|SQL' AS skills, concat(w, CASE c_custkey%4 WHEN 0 THEN ' University' WHEN 1 THEN ' Institute' WHEN 2 THEN ' College' ELSE ' School' END) AS institution,
 CASE c_custkey%4 WHEN 0 THEN 'Bachelor' WHEN 1 THEN 'Master' WHEN 2 THEN 'PhD' ELSE 'Secondary/Intermediate' END AS degree, CASE c_custkey%4 WHEN 0 THEN 'Physics' WHEN 1 THEN 'Applied Maths' WHEN 2 THEN 'Botany' ELSE 'Welding' END AS field,
 CASE c_custkey%4 WHEN 0 THEN 2019 WHEN 1 THEN 2016 WHEN 2 THEN 2021 ELSE 2010 END AS end_year FROM c""")
def resume_schools(spark, sf_dir):
    from kindred.operators import resume

    whole = F.col("text")
    rows = resumes(spark, sf_dir).select("c_custkey", text.name(text.lines(whole)).alias("name"), joined(text.emails(whole)).alias("emails"), joined(text.keywords(whole)).alias("skills"), F.explode(resume.education(whole)).alias("school"))
    return rows.select("c_custkey", "name", "emails", "skills", "school.*")
