"""Mixing sources to target weights by hierarchical budgets.

Sources are leaves of a tree: domain, language, source. The tokens wanted are divided among the domains by weight, each
domain's among its languages, and each language's among its sources. A node offers at most its tokens times the epochs allowed;
what it cannot offer goes to its siblings by their weights first, and only what a whole family lacks goes up to the parent's
siblings. A family's division is the level L at which sum(min(offer, L * weight)) is its budget, found by ordering its members
by offer / weight and adding up; so it is a window over the tree's nodes and never over documents. Budgets are whole tokens,
rounded down.

A leaf of budget B and T tokens gives floor(B / T) whole epochs and of one more epoch the documents in a seeded order, as long
as their tokens fit in the rest. The order is that of a hash of seed, epoch and key. Where the prefix ends is found from sums of
hash ranges; only the documents of the one range that the end falls in are ordered, so no leaf is ordered by one task.

Tokens are words (runs of other than white space). Null or empty texts and null keys have none and are never chosen; null
language or source are values of their own. Very long texts are counted whole. Rows that repeat a key are chosen or left together,
and ties in the seeded order go by key. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import materialize, prepare

#: Rows that a hash range of a leaf holds on average, as counted over all rows, up to so many ranges; beyond that they hold more.
RANGE, MOST_RANGES = 1000, 1 << 20
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Targets:
    """Whole-number weights by name for each level (others get `other`; 0 leaves a name out), the share wanted of the tokens that take part, epochs allowed."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    other: int = 10
    share: tuple[int, int] = (3, 5)
    epochs: int = 2
    seed: int = 20

    def weight(self, level: str) -> Column:
        out = F.lit(self.other)
        for name, w in self.weights.get(level, {}).items():
            out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
        return out.cast("decimal(38,0)")


#: The production mixture: sources by number belong to one of four domains; src0, the largest, is web text of its own.
PRODUCTION = Targets(weights={"domain": {"web": 30, "books": 20, "code": 20, "other": 30}, "lang": {"en": 40, "de": 20, "fr": 20, "es": 20}})


def domain_of(source: Column) -> Column:
    """The production domain of a source."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    number = F.when(number != "", number.cast("int"))
    return F.when(number % 4 == 0, "web").when(number % 4 == 1, "books").when(number % 4 == 2, "code").otherwise("other")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def divide(nodes: DataFrame, family: list[str]) -> DataFrame:
    """nodes (family..., offer, weight, wanted) with the column `budget`: what of the family's wanted tokens each member gives."""
    own = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    rank = own.orderBy(F.col("offer") / F.col("weight"), *[c for c in LEVELS if c in nodes.columns])
    upto, onward = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    big = "decimal(38,0)"
    nodes = nodes.withColumn("used", F.coalesce(F.sum("offer").over(upto), F.lit(0)).cast(big)).withColumn("rest", F.sum("weight").over(onward).cast(big))
    # A member is full if the level that holds when all before it are full reaches its offer; fullness is a prefix of the order.
    full = F.col("offer").cast(big) * F.col("rest") <= (F.col("wanted") - F.col("used")) * F.col("weight")
    nodes = nodes.withColumn("full", full)
    spent = F.sum(F.when(F.col("full"), F.col("offer")).otherwise(0)).over(own).cast(big)
    left = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(own).cast(big)
    nodes = nodes.withColumn("spent", spent).withColumn("left", left)
    part = F.expr("(wanted - spent) * weight div left").cast("long")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("offer")).otherwise(F.greatest(part, F.lit(0)))).drop("used", "rest", "full", "spent", "left")


def budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget: the tree's division, from the root down. Leaves of weight 0 at any level are left out."""
    for level in LEVELS:
        leaves = leaves.where(targets.weight(level) > 0)
    leaves = leaves.withColumn("offer", F.col("tokens") * targets.epochs)
    wanted = leaves.agg(F.expr(f"sum(tokens) * {targets.share[0]} div {targets.share[1]}").alias("wanted"))
    above: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("offer").alias("offer")).where("offer > 0").withColumn("weight", targets.weight(level))
        if above is None:
            nodes = nodes.withColumn("one", F.lit(1)).join(F.broadcast(wanted.withColumn("one", F.lit(1))), "one").drop("one")  # one row
        else:
            parent = above.select(*[F.col(c).alias(f"up_{c}") for c in path[:-1]], F.col("budget").alias("wanted"))
            same = [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in path[:-1]]
            nodes = nodes.join(parent, same).drop(*[f"up_{c}" for c in path[:-1]])
        above = materialize(divide(nodes.withColumn("wanted", F.col("wanted").cast("decimal(38,0)")), path[:-1]).drop("wanted", "weight"), level)
    return above.select(*LEVELS, F.expr(f"offer div {targets.epochs}").alias("tokens"), "budget")


def _slim(docs: DataFrame, key: str, text: str, lang: str, source: str, domain) -> DataFrame:
    """What the choice needs to know of each document that has words and a key."""
    rows = docs.select(domain(F.col(source)).alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source"), tokens(F.col(text)).alias("tokens"), F.col(key).alias("key"))
    return materialize(rows.where("tokens > 0 and key is not null"), "slim")


def _draw(targets: Targets, key: str, whole: str) -> Column:
    return F.xxhash64(F.lit(targets.seed), F.col(whole), F.col(key))


def _slot(h: Column, ranges: int) -> Column:
    return F.floor(F.shiftrightunsigned(h, 33).cast("double") / 2**31 * ranges).cast("long")


def _ends(slim: DataFrame, targets: Targets) -> tuple[DataFrame, int]:
    """Of each leaf, as columns that start with __: whole epochs, tokens of one more, and the range, hash and key with which its prefix ends; the number of ranges."""
    leaves = budgets(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), targets)
    leaves = leaves.withColumn("whole", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens"))
    leaves = materialize(leaves, "leaves")
    ranges = min(max(1, -(-slim.count() // RANGE)), MOST_RANGES)
    same = lambda a, b: [F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in LEVELS]
    own = [F.col(f"l_{c}") for c in LEVELS]
    tag = leaves.select(*[F.col(c).alias(f"l_{c}") for c in LEVELS], "whole", "rest")
    drawn = slim.join(tag, same("", "l_")).withColumn("slot", _slot(_draw(targets, "key", "whole"), ranges))
    sums = drawn.groupBy(*own, "slot").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*own).orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("tokens").over(run))
    # The range in which the prefix ends: the first whose running sum passes the rest.
    ends = sums.groupBy(*own).agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("slot", (F.col("upto") - F.col("tokens")).alias("before")))).alias("end"))
    ends = ends.select(*[F.col(f"l_{c}").alias(f"e_{c}") for c in LEVELS], F.col("end.slot").alias("last"), F.col("end.before").alias("before"))
    plan = materialize(leaves.join(ends, same("", "e_")).select(*[F.col(c).alias(f"p_{c}") for c in LEVELS], "whole", "rest", "last", "before"), "plan")
    edge = slim.join(plan, same("", "p_")).withColumn("h", _draw(targets, "key", "whole")).where(_slot(F.col("h"), ranges) == F.col("last"))
    # Rows of one key come together: their tokens are one step of the running sum.
    order = Window.partitionBy(*LEVELS).orderBy("h", "key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = edge.withColumn("upto", F.sum("tokens").over(order)).where("before + upto <= rest").groupBy("p_domain", "p_lang", "p_source").agg(F.max(F.struct("h", "key")).alias("top"))
    fits = fits.select(*[F.col(f"p_{c}").alias(f"f_{c}") for c in LEVELS], F.col("top.h").alias("top_h"), F.col("top.key").alias("top_key"))
    plan = plan.join(fits, same("p_", "f_"), "left").drop(*[f"f_{c}" for c in LEVELS])
    return materialize(plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns]), "ends"), ranges


def _taken(rows: DataFrame, ends: DataFrame, ranges: int, targets: Targets, key: str, leaf: list[str]) -> DataFrame:
    """The rows once for each epoch that has them, with `__epoch`; leaf: their columns of domain, language and source."""
    where = [F.col(own).eqNullSafe(F.col(f"__p_{c}")) for own, c in zip(leaf, LEVELS, strict=True)]
    out = rows.join(ends, where).withColumn("__h", _draw(targets, key, "__whole"))
    at, h, top = _slot(F.col("__h"), ranges), F.col("__h"), F.col("__top_h")
    fits = F.coalesce((h < top) | ((h == top) & (F.col(key) <= F.col("__top_key"))), F.lit(False))
    taken = (F.col("__rest") > 0) & (F.col("__last").isNull() | (at < F.col("__last")) | ((at == F.col("__last")) & fits))
    times = F.col("__whole") + F.when(taken, 1).otherwise(0)
    return out.withColumn("__epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1))))


def mixed(docs: DataFrame, targets: Targets = PRODUCTION, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain=domain_of) -> DataFrame:
    """The chosen rows of docs with all their columns and `__epoch`; a row comes once for each epoch that has it."""
    prepare(docs.sparkSession)
    ends, ranges = _ends(_slim(docs, key, text, lang, source, domain), targets)
    some = docs.where(F.col(key).isNotNull() & F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).withColumn("__domain", domain(F.col(source)))
    out = _taken(some, ends, ranges, targets, key, ["__domain", lang, source])
    return out.select(*[docs[c] for c in docs.columns], "__epoch")


def chosen(docs: DataFrame, targets: Targets = PRODUCTION, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain=domain_of) -> DataFrame:
    """A row for each chosen document and epoch: key, domain, lang, source, n_tokens, epoch."""
    prepare(docs.sparkSession)
    slim = _slim(docs, key, text, lang, source, domain)
    ends, ranges = _ends(slim, targets)
    out = _taken(slim, ends, ranges, targets, "key", list(LEVELS))
    return out.select(F.col("key").alias(key), "domain", F.col("lang").alias(lang), F.col("source").alias(source), F.col("tokens").alias("n_tokens"), F.col("__epoch").cast("int").alias("epoch"))
