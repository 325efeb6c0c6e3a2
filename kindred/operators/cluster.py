"""Which records describe one person.

A record joins the first group that holds a match of it, else opens one; groups never merge. With links from later to earlier
records, that is: a record's group is the smallest root that it reaches. So a link to a record may be left out if others lead there:
records with an equal email, phone or name are chained, each linked to the holder before it, and of two sets of records that all
match each other only those are linked that follow each other. Links then grow with the records, however many hold one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import fuzzy
from kindred.functions.scalars import folded, trimmed
from kindred.plans.tables import discard, kept, kept_counting, merging

#: Holders of a value from which it is ordered in ranges instead of one window, and ranges that it is cut into.
HOT, RANGES = 1 << 17, 256
#: Words of a name up to which it is dealt by pairs of its words.
PAIRED = 8
_TEXTS = "array<string>"
#: What one word can count for at most in a later name: kinds of these, the last one any.
SHARES = (1, 1.5, 2, None)
#: Later names of a block of a hot signal and part of a name.
BLOCK = 4096
#: Ways that are followed on in one round; a round makes them HOPS + 1 times as long.
HOPS = 4


def with_earlier(rows: DataFrame, by: list[str], holds: Column | None = None, at: str = "rec_ord") -> DataFrame:
    """rows with `earlier`: the greatest `at` below the row's own among rows of the same `by` that hold; null if there is none.

    Values with more than HOT rows are cut into ranges of `at`; each range is a window of its own, and the last holders before
    ranges come from the ranges' maxima.
    """
    own = F.col(at) if holds is None else F.when(holds, F.col(at))
    last = lambda c, parts, order: F.last(c, True).over(Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    if rows.count() <= HOT or sizes.agg(F.max("n")).first()[0] <= HOT:  # a written table knows its number of rows
        return rows.withColumn("earlier", last(own, by, at))
    hot = sizes.where(F.col("n") > HOT).select(*by, F.lit(True).alias("hot"))
    cuts = rows.join(hot, by).agg(F.percentile_approx(at, [k / RANGES for k in range(1, RANGES)], 100 * RANGES)).first()[0]
    place = F.aggregate(F.array(*map(F.lit, sorted(set(cuts)))), F.lit(0), lambda n, cut: n + (F.col(at) >= cut).cast("int"))
    dealt = rows.join(hot, by, "left").withColumn("range", F.when(F.col("hot"), place).otherwise(0)).drop("hot")
    most = dealt.groupBy(*by, "range").agg(F.max(own).alias("most"))
    before = most.withColumn("before", last(F.col("most"), by, "range")).drop("most")
    dealt = dealt.withColumn("earlier", last(own, [*by, "range"], at)).join(before, [*by, "range"])
    return dealt.withColumn("earlier", F.coalesce("earlier", "before")).drop("range", "before")


def key_links(records: DataFrame, *values: str) -> DataFrame:
    """(later, earlier): from each holder of a value of one of the array columns to the holder before it."""
    # The lambda has one parameter only: Spark would pass an element's place as a second one.
    of = lambda kind, c: F.transform(F.array_distinct(c), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    each = [of(k, c) for k, c in enumerate(values)]
    held = records.select("rec_ord", F.inline(F.flatten(F.array(*[F.coalesce(e, F.array().cast("array<struct<kind:int,value:string>>")) for e in each])))).where("value is not null").distinct()
    return with_earlier(kept(held, "held"), ["kind", "value"]).select(F.col("rec_ord").alias("later"), "earlier").where("earlier is not null")


def chained(held: DataFrame, linked: DataFrame) -> DataFrame:
    """(later, earlier) for holders (unit, rec_ord) of units of which some match: linked (later, earlier), also a unit with itself.

    A unit that matches itself is chained. Of two units that match, each holder of the one with fewer is linked to the other's
    last holder before it, and the other's next holder after it to the last such one: the chains lead to all others.
    """
    held, linked = kept(held, "held"), kept(linked, "linked")
    own = linked.where("later = earlier").select(F.col("later").alias("unit"))
    chain = with_earlier(kept(held.join(merging(own), "unit", "left_semi"), "chained"), ["unit"]).where("earlier is not null").select(F.col("rec_ord").alias("later"), "earlier")
    size = held.groupBy("unit").agg(F.count("*").alias("n"))
    pairs = linked.where("later != earlier").distinct().join(merging(size.select(F.col("unit").alias("later"), F.col("n").alias("n_later"))), "later").join(merging(size.select(F.col("unit").alias("earlier"), F.col("n").alias("n_earlier"))), "earlier")
    asks = F.struct("n_later", "later") < F.struct("n_earlier", "earlier")
    pairs = pairs.select(F.when(asks, F.col("later")).otherwise(F.col("earlier")).alias("unit"), F.when(asks, F.col("earlier")).otherwise(F.col("later")).alias("to"), asks.alias("asks"))
    # Those that ask stand among the holders that they ask for.
    rows = held.join(merging(pairs), "unit").select(F.col("to").alias("unit"), "rec_ord", F.col("unit").alias("from"), "asks")
    rows = held.join(merging(pairs.select(F.col("to").alias("unit")).distinct()), "unit", "left_semi").select("unit", "rec_ord", F.lit(None).cast(rows.schema["from"].dataType).alias("from"), F.lit(None).cast("boolean").alias("asks")).unionByName(rows)
    rows = kept(rows, "asking")
    holds = F.col("from").isNull()
    back = with_earlier(rows.where("asks is null or asks"), ["unit"], holds).where("asks and earlier is not null").select(F.col("rec_ord").alias("later"), "earlier")
    on = with_earlier(rows.where("asks is null or not asks").withColumn("minus", -F.col("rec_ord")), ["unit"], holds, "minus").where("not asks and earlier is not null")
    on = on.groupBy("unit", "from", (-F.col("earlier")).alias("later")).agg(F.max("rec_ord").alias("earlier")).select("later", "earlier")
    return chain.unionByName(back).unionByName(on)


def named(records: DataFrame) -> DataFrame:
    """rec_ord, words and what else decides about names, of records with a name."""
    extra = [c for c in ("companies", "location", "skills") if c in records.columns]
    return records.where("full_name is not null and full_name != ''").select("rec_ord", folded(F.col("full_name")).alias("words"), *extra)


def contained_names(names: DataFrame) -> DataFrame:
    """(later, earlier): which of the distinct names (unit: sorted words, two or more) match, if one comes after the other.

    A name without repeats matches names that hold all its words, so it meets them by its two rarest ones, among their pairs of
    words; names of very many words meet by the one rarest. A later name with repeats counts each, so it is summed up word by word.
    """
    names = names.select("unit", F.array_distinct("unit").alias("own"))
    word = names.select("unit", F.explode("own").alias("word"))
    rarity = word.groupBy("word").agg(F.count("*").alias("n"))
    rare = word.join(merging(rarity), "word").groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("all")).where(F.size("unit") == F.size("all"))
    pair = lambda x, y: F.xxhash64(F.least(x, y), F.greatest(x, y))
    one, two = F.col("all")[0]["word"], F.col("all")[1]["word"]
    asks = rare.select("unit", F.explode(F.array(pair(one, one), pair(one, two))).alias("key"))
    pairs = F.flatten(F.transform("own", lambda x, k: F.transform(F.slice(F.col("own"), k + 2, F.lit(PAIRED)), lambda y: pair(x, y))))
    dealt = names.select(F.col("unit").alias("other"), F.explode(F.when(F.size("own") <= PAIRED, pairs).otherwise(F.transform("own", lambda x: pair(x, x)))).alias("key"))
    met = asks.join(merging(dealt), "key").where("unit != other")
    both = met.select(F.col("unit").alias("later"), F.col("other").alias("earlier")).unionByName(met.select(F.col("other").alias("later"), F.col("unit").alias("earlier")))
    both = both.where(fuzzy.whole_overlap(F.col("later"), F.col("earlier")))
    repeats = names.where(F.size("unit") != F.size("own")).select(F.col("unit").alias("later"), F.explode("unit").alias("word"))
    summed = repeats.groupBy("later", "word").agg(F.count("*").alias("n")).join(merging(word.withColumnRenamed("unit", "earlier")), "word").where("later != earlier")
    summed = summed.groupBy("later", "earlier").agg(F.sum("n").alias("n")).where(F.col("n") == F.least(F.size("later"), F.size("earlier"))).select("later", "earlier")
    return both.unionByName(summed).unionByName(names.select(F.col("unit").alias("later"), F.col("unit").alias("earlier")))


def whole_overlap_links(records: DataFrame) -> DataFrame:
    """(later, earlier) where every word of the shorter of two names of two words or more is in the other, as far as `chained` needs them."""
    held = named(records).where(F.size("words") > 1).select(F.array_sort("words").alias("unit"), "rec_ord")
    held = kept(held, "names")
    return chained(held, contained_names(held.select("unit").distinct()))


def whole_overlap_pairs(records: DataFrame) -> DataFrame:
    """(later, earlier): all pairs of which `whole_overlap_links` has some. They grow with the square of a name's holders."""
    held = kept(named(records).where(F.size("words") > 1).select(F.array_sort("words").alias("unit"), "rec_ord"), "names")
    own = lambda place: held.select(F.col("unit").alias(place), F.col("rec_ord").alias(f"{place}_ord"))
    names = contained_names(held.select("unit").distinct()).distinct()
    both = names.join(merging(own("later")), "later").join(merging(own("earlier")), "earlier").where("later_ord > earlier_ord")
    return both.select(F.col("later_ord").alias("later"), F.col("earlier_ord").alias("earlier"))


def _pair(x: Column, y: Column) -> Column:
    return F.concat(F.least(x, y), F.lit(" "), F.greatest(x, y))


def overlap_asks(words: Column) -> Column:
    """What a later name asks for: of any name that it overlaps enough, `overlap_deals` has one of these.

    If the shorter name has two words or more, two places of the later name count, as a word of the other, an initial of one or
    one with an initial there; so names meet by two of these. A name of one word is a word of the other, or two initials count.
    Names of more than PAIRED words meet by one.
    """
    first = lambda w: F.substring(w, 1, 1)
    parts = lambda w: F.array(F.concat(F.lit("="), w), F.when(F.length(w) == 1, F.concat(F.lit("<"), w)).otherwise(F.concat(F.lit(">"), first(w))))
    both = lambda x, y: F.flatten(F.transform(parts(x), lambda u: F.transform(parts(y), lambda v: _pair(u, v))))
    pairs = F.flatten(F.transform(words, lambda x, k: F.flatten(F.transform(F.slice(words, k + 2, F.lit(PAIRED)), lambda y: both(x, y)))))
    single = F.flatten(F.transform(words, parts))
    tag = lambda t, c: F.transform(c, lambda x: F.concat(F.lit(t), x))
    own = F.when(F.size(words) <= PAIRED, pairs).otherwise(tag("long ", single))
    return F.array_distinct(F.concat(own, tag("to long ", single), tag("to one ", words), F.when(F.size(words) == 1, tag("one ", words)).otherwise(F.array().cast(_TEXTS))))


def overlap_deals(words: Column) -> Column:
    """What an earlier name has for `overlap_asks`."""
    part = lambda v: F.array(F.concat(F.lit("="), v), F.concat(F.lit("<"), F.substring(v, 1, 1)), F.when(F.length(v) == 1, F.concat(F.lit(">"), v)))
    parts = F.array_distinct(F.array_compact(F.flatten(F.transform(words, part))))
    tag = lambda t, c: F.transform(c, lambda x: F.concat(F.lit(t), x))
    pairs = F.flatten(F.transform(parts, lambda x, k: F.transform(F.slice(parts, k + 1, F.size(parts)), lambda y: _pair(x, y))))
    own = F.when(F.size(words) <= PAIRED, pairs).otherwise(tag("to long ", parts))
    return F.array_distinct(F.concat(own, tag("long ", parts), tag("one ", words), F.when(F.size(words) == 1, tag("to one ", words)).otherwise(F.array().cast(_TEXTS))))


def _asked(w: Column) -> Column:
    """What a word asks for: a word that counts for it has one of these as `_dealt`."""
    return F.array(F.concat(F.lit("="), w), F.when(F.length(w) == 1, F.concat(F.lit("<"), w)).otherwise(F.concat(F.lit(">"), F.substring(w, 1, 1))))


def _dealt(v: Column) -> Column:
    return F.array_compact(F.array(F.concat(F.lit("="), v), F.concat(F.lit("<"), F.substring(v, 1, 1)), F.when(F.length(v) == 1, F.concat(F.lit(">"), v))))


def _most_of_one(words: Column) -> Column:
    """What one word of another name can count for at most in a later name: more than 1 if words repeat or share an initial that stands there too, or by two."""
    of = lambda test: F.size(F.filter(words, test))
    first = lambda w: F.substring(w, 1, 1)
    whole = lambda w: of(lambda x: x == w) + F.when(F.length(w) > 1, of(lambda x: x == first(w)) / 2).otherwise(0)
    initial = lambda w: of(lambda x: x == first(w)) + of(lambda x: (F.length(x) > 1) & (first(x) == first(w))) / 2
    return F.array_max(F.transform(F.array_distinct(words), lambda w: F.greatest(whole(w), initial(w))))


def overlap_candidates(names: DataFrame) -> DataFrame:
    """(later, earlier): all pairs of the distinct names (words) that can overlap by OVERLAP or more, if one comes after the other, and some others.

    The shorter name meets the other by its rarest words, so many that one of them must count; a later name that is longer looks
    for those by what one word can count for at most in it (SHARES).
    """
    names = kept(names.withColumn("id", F.monotonically_increasing_id()), "names")
    flat = lambda ws, of: F.array_distinct(F.flatten(F.transform(ws, of)))
    counts = names.select(F.explode(flat(F.col("words"), _dealt)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    word = names.select("id", F.explode(F.array_distinct("words")).alias("word"))
    cost = word.select("word").distinct().select("word", F.explode(_asked(F.col("word"))).alias("key")).join(merging(counts), "key").groupBy("word").agg(F.sum("n").alias("cost"))
    rare = word.join(merging(cost), "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("cost", "word"))).alias("rare"))
    names = kept(names.join(merging(rare), "id").select("id", "words", F.transform("rare", lambda x: x["word"]).alias("rare")), "rare")
    size, tag = F.size("words"), lambda t, keys: F.transform(keys, lambda x: F.concat(F.lit(t), x))
    # Of the words of a shorter name so many count, or the names don't overlap enough.
    count = lambda share: F.ceil(size * fuzzy.OVERLAP / share).cast("int") if share else F.lit(0)
    some = lambda n: F.slice("rare", 1, F.greatest(n, F.lit(1)))
    short = F.when(size == 1, F.transform("words", lambda w: F.concat(F.lit("="), w))).otherwise(flat(some(size - count(1) + 1), _asked))
    long = [tag(f"{k} ", flat(some(F.size("rare") - count(share) + 1), _asked)) for k, share in enumerate(SHARES)]
    most = F.lit(len(SHARES) - 1)
    for k in reversed(range(len(SHARES) - 1)):
        most = F.when(_most_of_one(F.col("words")) <= SHARES[k], k).otherwise(most)
    whole = flat(F.col("words"), _dealt)
    side = lambda who, keys: names.select(F.col("id").alias(who), size.alias(f"{who}_size"), F.explode(keys).alias("key"))
    met = side("later", short).join(merging(side("earlier", whole)), "key").where("later_size <= earlier_size").select("later", "earlier")
    kind = F.concat(most.cast("string"), F.lit(" "))
    longer = side("later", F.transform(whole, lambda x: F.concat(kind, x))).join(merging(side("earlier", F.concat(*long))), "key").where("later_size > earlier_size").select("later", "earlier")
    met = met.unionByName(longer).distinct()
    own = lambda who: names.select(F.col("id").alias(who), F.col("words").alias(f"{who}_words"))
    return met.join(merging(own("later")), "later").join(merging(own("earlier")), "earlier").select(F.col("later_words").alias("later"), F.col("earlier_words").alias("earlier"))


def overlapping_names(names: DataFrame) -> DataFrame:
    """(later, earlier, ratio): which of the distinct names (words) overlap by OVERLAP or more, if one comes after the other."""
    return overlap_candidates(names).withColumn("ratio", fuzzy.overlap(F.col("later"), F.col("earlier"))).where(F.col("ratio") >= fuzzy.OVERLAP)


def shared_company(a: Column, b: Column) -> Column:
    fold = lambda c: F.filter(F.transform(c, lambda x: trimmed(F.lower(x))), lambda x: x != "")
    return F.coalesce(F.arrays_overlap(fold(a), fold(b)), F.lit(False))


def shared_location(a: Column, b: Column) -> Column:
    fold = lambda c: F.nullif(trimmed(F.lower(c)), F.lit(""))
    same = [F.coalesce(fold(a[k]) == fold(b[k]), F.lit(False)) for k in ("city", "region", "country")]
    return same[0] | same[1] | same[2]


def shared_skills(a: Column, b: Column, least: int = 3) -> Column:
    """Whether `least` skills of a are in b; repeats in a count."""
    fold = lambda c: F.transform(c, lambda s: F.lower(s["name"]))
    return F.coalesce(F.size(F.filter(fold(a), lambda x: F.array_contains(fold(b), x))) >= least, F.lit(False))


def signals(people: DataFrame) -> DataFrame:
    """(rec_ord, words, kind, of): what a record has that can be equal in another's: a company, a part of a place, or skills (their list)."""
    text = lambda c: F.nullif(trimmed(F.lower(c)), F.lit(""))
    told = lambda kind, c: F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.array(c).alias("of")))
    skills = F.array_sort(F.transform("skills", lambda s: F.lower(s["name"])))
    of = F.concat(
        F.coalesce(F.transform("companies", lambda c: told("company", text(c))), F.array().cast("array<struct<kind:string,of:array<string>>>")),
        F.array(*[told(k, text(F.col("location")[k])) for k in ("city", "region", "country")], F.when(F.size("skills") > 0, F.struct(F.lit("skills").alias("kind"), skills.alias("of")))),
    )
    return people.select("rec_ord", "words", F.explode(F.array_distinct(F.array_compact(of))).alias("s")).select("rec_ord", "words", "s.kind", "s.of")


def close_name_links(records: DataFrame) -> DataFrame:
    """(later, earlier) with close names and a company, a place or three skills in common, as far as `chained` needs them.

    Units are a name with a signal. Names that overlap enough share what `overlap_asks` tells; names that are alike as wholes
    share a piece of the later one. So units meet by signal (of skills, each) and such a part, hot ones in blocks, and each two
    names are compared once.
    """
    held = signals(named(records)).withColumn("unit", F.xxhash64("words", "kind", "of")).withColumn("own", F.struct("words", "kind", "of"))
    held = kept(held.select("unit", "rec_ord", "own"), "signals")
    units = kept(held.groupBy("unit").agg(F.min("own").alias("own")).select("unit", "own.*"), "units")
    name, piece = F.array_join("words", " "), lambda c: F.transform(c, lambda x: F.concat(F.lit("piece "), x))
    asks = F.concat(overlap_asks(F.col("words")), F.array_distinct(piece(fuzzy.pieces(name))))
    dealt = F.concat(overlap_deals(F.col("words")), piece(fuzzy.grams(name)))
    side = lambda parts, unit: units.select(F.col("unit").alias(unit), F.explode(F.array_distinct("of")).alias("of"), "kind", parts.alias("parts")).select(unit, "kind", "of", F.explode("parts").alias("part"))
    key, later = ["kind", "of", "part"], side(asks, "later")
    blocks = later.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    count = F.coalesce("blocks", F.lit(1).cast("long"))
    later = later.join(merging(blocks), key, "left").withColumn("block", F.pmod(F.xxhash64("later", F.lit(1)), count)).drop("blocks")
    earlier = side(dealt, "earlier").join(merging(blocks), key, "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop("blocks")
    met = kept(later.join(merging(earlier), [*key, "block"]).select("later", "earlier").distinct(), "met")
    own = lambda who, s: units.select(F.col("unit").alias(who), F.col("words").alias(f"words_{s}"), F.col("of").alias(f"of_{s}"), F.col("kind").alias(f"kind_{s}"))
    shared = F.size(F.filter("of_a", lambda x: F.array_contains("of_b", x)))
    met = met.join(merging(own("later", "a")), "later").join(merging(own("earlier", "b")), "earlier").where((F.col("kind_a") != "skills") | (shared >= 3))
    text = lambda s: F.array_join(f"words_{s}", " ")
    over = F.coalesce(fuzzy.overlap(F.col("words_a"), F.col("words_b")) >= fuzzy.OVERLAP, F.lit(False)) | (text("a") == text("b"))
    met = met.withColumn("over", over)
    maybe = met.where("not over")
    names = maybe.select("words_a", "words_b").distinct().where(fuzzy.close_names(text("a"), text("b")))
    linked = met.where("over").select("later", "earlier").unionByName(maybe.join(merging(names), ["words_a", "words_b"]).select("later", "earlier"))
    return chained(held.select("unit", "rec_ord"), linked)


def match_links(records: DataFrame) -> DataFrame:
    """Links (later, earlier) of records (rec_ord, full_name, emails, phones and, if they are there, companies, location, skills) that lead to all matches."""
    links = key_links(records, "emails", "phones").unionByName(whole_overlap_links(records))
    if {"companies", "location", "skills"} <= set(records.columns):
        links = links.unionByName(close_name_links(records))
    return links.distinct()


def roots(records: DataFrame, links: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(rec_ord, group_id): the smallest root that each record reaches over links (later, earlier).

    Each record holds one way on: at first its earliest link. Ways are followed several at once, so chains of any length end in a
    logarithmic number of rounds; the end is the record's label. Where a link leads to a lesser label than the way does, the way
    goes there from now on, until none does. So a round holds a row for each record with links, besides the links.
    """
    links = kept(links.where("later > earlier").distinct(), "links")
    way = kept(links.groupBy("later").agg(F.min("earlier").alias("far")), "way")
    for _ in range(most_rounds):
        for _ in range(most_rounds):
            further = way.withColumn("moved", F.lit(False))
            for _ in range(HOPS):
                on = way.select(F.col("later").alias("far"), F.col("far").alias("next"))
                further = further.join(merging(on), "far", "left").select("later", F.coalesce("next", "far").alias("far"), (F.col("moved") | F.col("next").isNotNull()).alias("moved"))
            further, moved = kept_counting(further, "way", F.col("moved"))
            discard(way)
            way = further.select("later", "far")
            if not moved:
                break
        end = way.select(F.col("later").alias("earlier"), F.col("far").alias("label"))
        best = links.join(merging(end), "earlier", "left").groupBy("later").agg(F.min(F.struct(F.coalesce("label", "earlier").alias("label"), "earlier")).alias("best"))
        told = way.join(merging(best), "later").select("later", "far", F.col("best.label").alias("label"), F.col("best.earlier").alias("to"))
        told, changed = kept_counting(told, "told", F.col("label") < F.col("far"))
        discard(way)
        way = told.select("later", "far")
        if not changed:
            break
        way = kept(told.select("later", F.col("to").alias("far")), "way")
        discard(told)
    else:
        raise RuntimeError(f"no rest after {most_rounds} rounds")
    return records.select("rec_ord").join(merging(way.withColumnRenamed("later", "rec_ord")), "rec_ord", "left").select("rec_ord", F.coalesce("far", "rec_ord").alias("group_id"))


def cluster(records: DataFrame) -> DataFrame:
    """records with group_id, written to the shared folder."""
    own = [c for c in ("rec_ord", "full_name", "emails", "phones", "companies", "location", "skills") if c in records.columns]
    plain = kept(records.select(own), "records")
    return kept(records.join(merging(roots(plain, match_links(plain))), "rec_ord"), "grouped")
