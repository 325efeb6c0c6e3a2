import decimal

import pytest
from pyspark.sql import functions as F

from kindred.functions import fuzzy, present, scalars, text


def one(spark, column, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{k} {'double' if isinstance(v, float) else 'string'}" for k, v in enumerate(values)))
    return row.select(column(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("(206) 555-0188", "+12065550188"), ("+12065550188", "+12065550188"), ("2065550188", "+12065550188"), ("ask at the desk", "ask at the desk"), (None, None), ("1 206 555 0188", "+12065550188"), ("011 44 161 496 0123", "+441614960123")])
def test_phone(spark, raw, want):
    assert one(spark, scalars.e164, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("2014-11", "2014-11"), ("2016", "2016-01"), ("Oct 2012", "2012-10"), ("August 2009", "2009-08"), ("Present", None), ("Current", None), ("03/2015", "2015-03"), ("09-2011", "2011-09"), ("long ago", None), ("2013/07/22", "2013-07"), ("April, 2008", "2008-04"), ("Winter 2010", "2010-01")])
def test_month(spark, raw, want):
    assert one(spark, scalars.month, raw) == want


def test_fixed2_is_exact(spark):
    values = [k / 1000 for k in range(2001)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", scalars.fixed2(F.col("x")).alias("y")).collect()
    for r in got:
        exact = decimal.Decimal(r.x).quantize(decimal.Decimal("0.01"), rounding=decimal.ROUND_HALF_UP)
        assert r.y == float(exact)


def test_skills():
    assert fuzzy.best_skill("javascript") == ("JavaScript", 1.0)
    name, sure = fuzzy.best_skill("nodejs")
    assert name == "Node.js" and sure > 0.6
    assert fuzzy.best_skill("Cobol") == ("Cobol", 0.4)
    assert fuzzy.best_skill(None) == ("Unknown", 0.1)


@pytest.mark.parametrize(("line", "start", "end"), [("Oct 2011 - Feb 2014", "2011-10", "2014-02"), ("June 2018 - Present", "2018-06", "Present"), ("2006 - 2009", "2006-01", "2009-01"), ("2012-04 - 2013-09", "2012-04", "2013-09"), ("none", None, None), ("BrewerMarch 2015 - June 2016", "2015-03", "2016-06")])
def test_date_range(spark, line, start, end):
    got = one(spark, text.date_range, line)
    assert (got.start, got.end) == (start, end)


def test_links(spark):
    got = one(spark, text.links, "linkedin.com/in/petra | github.com/petra")
    assert (got.linkedin, got.github) == ("https://linkedin.com/in/petra", "https://github.com/petra")


def test_slug(spark):
    assert one(spark, scalars.slug_name, "petra-van-dijk-7c01f44e2") == "Petra Van Dijk"


def test_presentation(spark):
    assert one(spark, present.month_label, "2024-02") == "Feb 2024"
    assert one(spark, present.tier, 0.9) == "REFINED"
    assert one(spark, present.source_family, "linkedin_api.json") == "linkedin"


def test_masked(spark):
    assert one(spark, scalars.masked, "db://user:pass@host") == "db://user:****@host"
