"""What is found in free text: emails, phones, links, names, keywords, date ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.scalars import MONTH_NAME, month_number, trimmed

# The patterns decide what counts as an email, a phone or a link.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
URL = r"https?://[^\s$.?#].[^\s]*"
BARE = r"(?i)\b(?:linkedin\.com/in/[^\s|,;]+|github\.com/[^\s|,;]+)"
# Keywords in the order in which they are reported; JS, TS and Golang are other names.
KEYWORDS = (
    "JavaScript", "JS", "TypeScript", "TS", "Python", "Java", "C++", "C#", "Ruby", "PHP", "Go", "Golang", "Rust", "Swift", "HTML", "CSS", "Sass", "Less",
    "Tailwind", "Bootstrap", "React", "Angular", "Vue", "Next.js", "Nuxt.js", "Express", "NestJS", "Koa", "Django", "Flask", "Spring", "Spring Boot",
    "MongoDB", "PostgreSQL", "MySQL", "SQLite", "Redis", "Elasticsearch", "SQL", "NoSQL", "Docker", "Kubernetes", "AWS", "GCP", "Azure", "Git", "GitHub",
    "GitLab", "CI/CD", "Jenkins", "Travis", "Machine Learning", "ML", "Deep Learning", "NLP", "Data Science", "PyTorch", "TensorFlow",
)
SYNONYMS = {"JS": "JavaScript", "TS": "TypeScript", "Golang": "Go"}


def let(value: Column, use) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def some(c: Column) -> Column:
    """c, or null if it is empty; unlike `nullif` it works c out once within another function's argument too."""
    return let(c, lambda x: F.when(x != "", x))


def every(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def last(c: Column) -> Column:
    return F.try_element_at(c, F.lit(-1))


def lines(c: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: F.length(x) > 0)


def emails(c: Column) -> Column:
    return F.array_distinct(F.transform(every(c, EMAIL), F.lower))


def phones(c: Column) -> Column:
    return F.array_distinct(every(c, PHONE))


def urls(c: Column) -> Column:
    """Links with a scheme, one trailing mark taken off."""
    return F.transform(every(c, URL), lambda u: F.regexp_replace(u, "[,;.)]$", ""))


def routed(found: Column) -> dict[str, Column]:
    """Links by where they lead; the last one of a kind counts, others are kept in order."""
    has = lambda *words: lambda u: F.lit(False) if not words else _any(u, words)
    here = ("linkedin.com",), ("github.com",), ("portfolio", "personal", "blog")
    only = lambda k: F.filter(found, lambda u: has(*here[k])(u) & ~_any(u, tuple(w for words in here[:k] for w in words)))
    return {"linkedin": last(only(0)), "github": last(only(1)), "portfolio": last(only(2)), "other": F.filter(found, lambda u: ~_any(u, tuple(w for words in here for w in words)))}


def _any(u: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | u.contains(w)
    return out


def bare(c: Column, host: str) -> Column:
    """The first link to a host that is written without a scheme, with https:// put before it."""
    found = F.transform(every(c, BARE), lambda u: F.regexp_replace(u, "[,;.)]$", ""))
    return F.concat(F.lit("https://"), first(F.filter(found, lambda u: u.contains(host))))


def links(c: Column) -> Column:
    by = routed(urls(c))
    return F.struct(F.coalesce(by["linkedin"], bare(c, "linkedin.com")).alias("linkedin"), F.coalesce(by["github"], bare(c, "github.com")).alias("github"), by["portfolio"].alias("portfolio"), by["other"].alias("other"))


def name(ls: Column) -> Column:
    """The first line that could be a name, else the first line."""
    words = lambda x: F.split(x, r"\s+")
    fits = lambda x: (
        ~x.contains("@") & ~x.rlike(r"\d{4}") & ~F.lower(x).contains("resume") & ~F.lower(x).contains("curriculum")
        & F.size(words(x)).between(2, 4) & F.forall(words(x), lambda w: w.rlike("^[A-Za-z]"))
    )
    return F.coalesce(first(F.filter(ls, fits)), first(ls))


def keywords(c: Column, terms: tuple[str, ...] = KEYWORDS, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """The terms that stand in a text by themselves, in the order of the list, other names as their main one."""

    def stands(term: str) -> Column:
        plain = "".join("\\" + ch if not (ch.isalnum() or ch == " ") else ch for ch in term)
        return c.rlike(rf"(?i)(?<![A-Za-z0-9_]){plain}(?![A-Za-z0-9_])")

    return F.array_distinct(F.array_compact(F.array(*[F.when(stands(t), synonyms.get(t, t)) for t in terms])))


# How months, years and the present are written.
MONTH_LONG = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
# A month may follow a lower-case letter directly (a word glued to it), but no other sign of a word.
NAMED = rf"(?:(?<![A-Za-z0-9_])|(?<=[a-zA-Z]))((?i:{MONTH_LONG}))\.?\s+((?:19|20)\d\d)(?![A-Za-z0-9_])"
NUMBERED = r"(?<![A-Za-z0-9_])((?:19|20)\d\d)[-/](\d\d)(?![A-Za-z0-9_])"
YEAR = r"(?<![A-Za-z0-9_])((?:19|20)\d\d)(?![A-Za-z0-9_])"
PRESENT = r"(?i)(?<![A-Za-z0-9_])(present|current)(?![A-Za-z0-9_])"


def date_range(line: Column) -> Column:
    """struct<start, end, span> of a line: months by name, else by number, else years; a second date or `Present` is the end."""
    month_of = lambda d: F.concat(F.regexp_extract(d, r"(\d{4})$", 1), F.lit("-"), month_number(d))
    none = F.lit(None).cast("string")

    def tier(pattern: str, told) -> Column:
        def of(found: Column) -> Column:
            tail = F.regexp_extract(line, rf"{pattern}[\s\S]*$", 0)
            two, present = F.size(found) > 1, tail.rlike(PRESENT)
            end = F.when(two, told(F.get(found, F.lit(1)))).when(present, F.lit("Present"))
            span = F.when(two, F.regexp_extract(line, rf"{pattern}[\s\S]*{pattern}", 0)).when(present, F.regexp_extract(line, rf"{pattern}[\s\S]*?{PRESENT}", 0)).otherwise(first(found))
            return F.when(F.size(found) > 0, F.struct(told(first(found)).alias("start"), end.alias("end"), span.alias("span")))

        return let(every(line, pattern), of)

    tiers = (NAMED, month_of), (NUMBERED, lambda d: F.regexp_replace(d, "/", "-")), (YEAR, lambda d: F.concat(d, F.lit("-01")))
    return F.coalesce(*[tier(*t) for t in tiers], F.struct(none.alias("start"), none.alias("end"), none.alias("span")))
