"""Editorial records: time and region scoped entries with triggers, their checks, compilation, matching and gate.

A record is a row: id, kind, status, window (struct of from, to, recurs; null: always),
regions and except_regions (arrays, `*` for all), locales, triggers (map of locale to
phrases), items (array of struct of id and weight), context (map), outranks, featured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.analytics import rank
from lexiloom.sources.tables import kept

#: The order of kinds, limits of a record, matches of a query, and the rule of a trigger being typed.
KINDS = ("seasonal", "event", "regional", "meme", "general")
MAX_DAYS = {"event": 60, "seasonal": 92}
MAX_MATCHES, MIN_PREFIX = 4, 3
LIMITS = {"triggers": (1, 12), "items": (1, 8), "trigger_length": 40}


def active_on(window: Column, day: Column) -> Column:
    """Whether a window holds on a day (yyyy-MM-dd); yearly ones are months and days and may pass the year's end."""
    first, last, month_day = window["from"], window["to"], F.substring(day, 6, 5)
    yearly = F.when(first <= last, month_day.between(first, last)).otherwise((month_day >= first) | (month_day <= last))
    return window.isNull() | F.when(window["recurs"] == "yearly", yearly).otherwise(day.between(first, last))


def active_between(window: Column, first: str, last: str) -> Column:
    """Whether a window holds on any day of a range."""
    days = F.transform(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last))), lambda d: F.date_format(d, "yyyy-MM-dd"))
    dated = (window["from"] <= last) & (window["to"] >= first)
    return window.isNull() | F.when(window["recurs"] == "yearly", F.exists(days, lambda d: active_on(window, d))).otherwise(dated)


def in_scope(region: Column, day: Column) -> Column:
    """Whether an entry applies in a region (null: none) on a day."""
    code = F.upper(region)
    listed = F.array_contains("regions", F.lit("*")) | F.coalesce(F.array_contains("regions", code), F.lit(False))
    excepted = F.coalesce(F.array_contains("except_regions", code), F.lit(False))
    return listed & ~excepted & active_on(F.col("window"), day)


def compiled(records: DataFrame, locale: str, first: str, last: str, catalog: DataFrame, statuses: tuple[str, ...] = ("approved",)) -> DataFrame:
    """A locale's entries for a range of days, in order: id, kind, context, window, regions, except_regions, triggers, items, featured, outranks, place.

    catalog: item (known ids). Items go strongest first; entries without known
    items go, and those without triggers unless they are featured.
    """
    live = records.filter(F.col("status").isin(*statuses) & F.array_contains("locales", F.lit(locale)) & active_between(F.col("window"), first, last))
    items = live.select("id", F.posexplode("items").alias("at", "i")).select("id", "at", F.col("i.id").alias("item"), "i.weight")
    known = items.join(catalog.select("item"), "item").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), "at", "item", "weight"))), lambda x: F.struct(x["item"].alias("id"), x["weight"].alias("weight"))).alias("known"))
    shown = F.col("featured") & F.col("kind").isin("seasonal", "event")
    own = F.coalesce(F.element_at("triggers", locale), F.array().cast("array<string>"))
    rows = live.join(known, "id").select("id", "kind", F.coalesce(F.element_at("context", locale), F.element_at("context", "en"), F.lit("")).alias("context"), "window", "regions", "except_regions", own.alias("triggers"), F.col("known").alias("items"), shown.alias("featured"), F.when(F.col("kind") == "regional", F.col("outranks")).alias("outranks"))
    rows = rows.filter((F.size("triggers") > 0) | F.col("featured"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return rows.withColumn("place", rank(Window.partitionBy(F.lit(locale)).orderBy(order, "id")))  # editors write these records: a locale has thousands at most


def trigger_quality(trigger: Column, q: Column, typing: Column) -> Column:
    """1 for the whole trigger, less for one being typed, 0 otherwise."""
    begun = typing & (F.length(q) >= MIN_PREFIX) & (2 * F.length(q) >= F.length(trigger)) & F.startswith(trigger, q)
    return F.when(trigger == q, 1.0).when(begun, 0.6 + 0.4 * F.length(q) / F.length(trigger)).otherwise(0.0)


def begun(entries: DataFrame) -> DataFrame:
    """Entries by every text that can hit one of their triggers: the trigger and its longer halves."""
    each = entries.select("*", F.explode("triggers").alias("trigger")).filter("trigger <> ''")
    least = F.least(F.length("trigger"), F.greatest(F.lit(MIN_PREFIX), F.ceil(F.length("trigger") / 2).cast("int")))
    return each.withColumn("q", F.explode(F.transform(F.sequence(least, F.length("trigger")), lambda n: F.left(F.col("trigger"), n))))


def _of_record(hits: DataFrame) -> DataFrame:
    """Where queries name a record (column `only`), hits of that one alone."""
    return hits.filter(F.col("only") == F.col("id")) if "only" in hits.columns else hits


def matched(queries: DataFrame, entries: DataFrame, limit: int = MAX_MATCHES) -> DataFrame:
    """query_id, place, item, score, entry, match: items of the entries in scope that a query's text triggers.

    queries: query_id, q (normalised), typing, region, day, and `only` where a query is for one record.
    Met by an equi-join on the texts that can hit a trigger.
    """
    hits = _of_record(queries.join(begun(entries), "q")).filter(in_scope(F.col("region"), F.col("day")))
    hits = hits.withColumn("quality", trigger_quality(F.col("trigger"), F.col("q"), F.col("typing"))).filter("quality > 0")
    return _items(hits, limit)


def matched_in_text(texts: DataFrame, entries: DataFrame, most: int = 6, limit: int = MAX_MATCHES) -> DataFrame:
    """matched() for whole texts: triggers that stand in them as whole words. texts: query_id, toks, region, day. most: words of the longest trigger."""
    from lexiloom.functions.text import windows

    each = entries.select("*", F.explode("triggers").alias("trigger"))
    scope = F.to_json(F.struct("region", "day")).alias("scope")
    windowed = texts.select("query_id", "region", "day", scope, F.explode(F.array_distinct(windows(F.col("toks"), most))).alias("trigger"))
    runs = kept(windowed.join(each.select("trigger").distinct(), "trigger", "left_semi"), "runs")
    # Each trigger's items once a scope, whatever the number of texts that hold it.
    hits = runs.select("scope", "region", "day", "trigger").distinct().join(each, "trigger").filter(in_scope(F.col("region"), F.col("day")))
    items = hits.select("scope", "trigger", F.col("id").alias("entry"), F.col("place").alias("entry_place"), F.posexplode("items").alias("at", "i"))
    scored = items.select("scope", "trigger", F.col("i.id").alias("item"), "entry", "entry_place", "at", _score(F.col("i.weight")).alias("score")).filter("score > 0")
    best = F.min_by(F.struct("score", "entry", "entry_place", "at"), F.struct(-F.col("score"), "entry_place", "at")).alias("r")
    own = kept(scored.groupBy("scope", "trigger", "item").agg(best, F.min(F.struct("entry_place", "at")).alias("born")), "trigger-items")
    # Texts of equal scope and triggers have equal matches. An item that only one of the
    # triggers has can be among the first only if it is among that trigger's first, as
    # those before it stay before it; items of several triggers are all looked at.
    alike = runs.groupBy("query_id", "scope").agg(F.array_sort(F.collect_set("trigger")).alias("all"))
    kinds = alike.select("scope", "all").distinct()
    pairs = kinds.select("scope", "all", F.explode("all").alias("trigger")).select("*", F.explode(F.filter("all", lambda x: x > F.col("trigger"))).alias("other"))
    firsts = own.withColumn("n", rank(Window.partitionBy("scope", "trigger").orderBy(-F.col("r.score"), "born"))).filter(F.col("n") <= limit).select("scope", "trigger", "item")
    asked = kinds.select("scope", "all", F.explode("all").alias("trigger"))
    left, right = own.select("scope", "trigger", "item"), own.select("scope", F.col("trigger").alias("other"), "item")
    shared = left.join(right, ["scope", "item"]).filter(F.col("trigger") < F.col("other"))
    found = asked.join(firsts, ["scope", "trigger"]).select("scope", "all", "item").unionByName(pairs.join(shared, ["scope", "trigger", "other"]).select("scope", "all", "item")).distinct()
    rows = found.withColumn("trigger", F.explode("all")).join(own, ["scope", "trigger", "item"])
    order = F.struct(-F.col("r.score"), "r.entry_place", "r.at", -F.length("trigger"), "trigger")
    one = rows.groupBy("scope", "all", "item").agg(F.min_by(F.struct("r.score", "r.entry", F.col("trigger").alias("match")), order).alias("r"), F.min("born").alias("born"))
    placed = one.withColumn("place", rank(Window.partitionBy("scope", "all").orderBy(F.desc("r.score"), "born"))).filter(F.col("place") <= limit)
    return alike.join(placed, ["scope", "all"]).select("query_id", "place", "item", "r.score", "r.entry", "r.match")


def _score(strength: Column) -> Column:
    """In thousandths, halves up."""
    return F.floor(F.round(strength, 9) * 1000 + 0.5) / 1000


def _items(hits: DataFrame, limit: int) -> DataFrame:
    best = hits.groupBy("query_id", F.col("id").alias("entry")).agg(F.min_by(F.struct("trigger", "quality", "items", "place"), F.struct(-F.col("quality"), -F.length("trigger"), "trigger")).alias("r")).select("query_id", "entry", "r.*")
    items = best.select("query_id", "entry", "quality", F.col("place").alias("entry_place"), F.col("trigger").alias("match"), F.posexplode("items").alias("at", "i"))
    scored = items.select("query_id", F.col("i.id").alias("item"), "entry", "match", "entry_place", "at", _score(F.col("i.weight") * F.col("quality")).alias("score")).filter("score > 0")
    one = scored.groupBy("query_id", "item").agg(F.min_by(F.struct("score", "entry", "match", "entry_place", "at"), F.struct(-F.col("score"), "entry_place", "at")).alias("r"), F.min(F.struct("entry_place", "at")).alias("born")).select("query_id", "item", "r.*", "born")
    placed = one.withColumn("place", rank(Window.partitionBy("query_id").orderBy(F.desc("score"), "born"))).filter(F.col("place") <= limit)
    return placed.select("query_id", "place", "item", "score", "entry", "match")


def regional_leads(queries: DataFrame, entries: DataFrame, tops: DataFrame) -> DataFrame:
    """query_id, item, score, entry: the strongest item of a regional entry that outranks the query's top result (query_id, item)."""
    each = entries.filter("kind = 'regional'").select("*", F.explode("triggers").alias("q"))
    hits = _of_record(queries.filter("region is not null").join(each, "q")).join(tops.select("query_id", F.col("item").alias("top")), "query_id")
    hits = hits.filter(F.array_contains("outranks", F.col("top")) & in_scope(F.col("region"), F.col("day"))).withColumn("strong", F.get("items", F.lit(0)))
    hits = hits.filter(F.col("strong.id") != F.col("top"))
    return hits.groupBy("query_id").agg(F.min_by(F.struct(F.col("strong.id").alias("item"), F.col("strong.weight").alias("score"), F.col("id").alias("entry")), F.struct(-F.col("strong.weight"), "place")).alias("r")).select("query_id", "r.*")


def applied(results: DataFrame, matches: DataFrame, leads: DataFrame, limit: int = 24) -> DataFrame:
    """query_id, place, item, tier: a lead (0), the top result (1), matches (2), the rest (3); an item once, at its first place."""
    top = results.filter("place = 1")
    rows = leads.join(top.select("query_id"), "query_id", "left_semi").select("query_id", "item", F.lit(0).alias("tier"), F.lit(1).cast("long").alias("was"))
    rows = rows.unionByName(results.select("query_id", "item", F.when(F.col("place") == 1, 1).otherwise(3).alias("tier"), F.col("place").alias("was")))
    rows = rows.unionByName(matches.select("query_id", "item", F.lit(2).alias("tier"), F.col("place").alias("was")))
    one = rows.groupBy("query_id", "item").agg(F.min(F.struct("tier", "was")).alias("r")).select("query_id", "item", "r.*")
    placed = one.withColumn("place", rank(Window.partitionBy("query_id").orderBy("tier", "was", "item"))).filter(F.col("place") <= limit)
    return placed.select("query_id", "place", "item", "tier")


def problems(records: DataFrame, catalog: DataFrame, excluded: list[str]) -> DataFrame:
    """id, level, message: what is wrong with a record, by rules about its lengths, window, regions, items and triggers."""
    window, all_triggers = F.col("window"), F.array_distinct(F.flatten(F.map_values("triggers")))
    day = lambda c: F.try_to_date(F.when(window["recurs"] == "yearly", F.concat(F.lit("2024-"), c)).otherwise(c), "yyyy-MM-dd")
    first, last = day(window["from"]), day(window["to"])
    days = F.datediff(last, first) + 1
    days = F.when((window["recurs"] == "yearly") & (days <= 0), days + 366).otherwise(days)
    longest = F.when(F.col("kind") == "event", MAX_DAYS["event"]).when(F.col("kind") == "seasonal", MAX_DAYS["seasonal"])
    padded = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    banned = F.exists(all_triggers, lambda t: F.exists(F.array(*map(F.lit, excluded)).cast("array<string>"), lambda p: F.contains(padded(t), padded(p))))
    rules = [
        ("error", "window without a valid day", window.isNotNull() & (first.isNull() | last.isNull())), ("error", "window ends before it begins", (window["recurs"].isNull()) & (days <= 0)),
        ("error", "window too long", days > longest), ("error", "event or season without a window", window.isNull() & F.col("kind").isin(*MAX_DAYS)),
        ("error", "no region", F.size("regions") == 0), ("error", "exceptions need all regions", (F.size("except_regions") > 0) & ~F.array_contains("regions", F.lit("*"))),
        ("error", "too few or many triggers", ~F.size(all_triggers).between(*LIMITS["triggers"])), ("error", "trigger too long", F.exists(all_triggers, lambda t: F.length(t) > LIMITS["trigger_length"])),
        ("error", "too few or many items", ~F.size("items").between(*LIMITS["items"])), ("error", "weight out of range", F.exists("items", lambda i: (i["weight"] <= 0) | (i["weight"] > 1))),
        ("error", "excluded phrase", banned), ("warning", "unapproved", F.col("status") != "approved"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(text).alias("message"))) for level, text, test in rules]), lambda r: r.isNotNull())
    own = records.select("id", F.explode(found).alias("p")).select("id", "p.*")
    lost = records.select("id", F.explode("items").alias("i")).select("id", F.col("i.id").alias("item")).join(catalog.select("item"), "item", "left_anti").select("id", F.lit("error").alias("level"), F.lit("unknown item").alias("message")).distinct()
    repeated = records.groupBy("id").count().filter("count > 1").select("id", F.lit("error").alias("level"), F.lit("id used twice").alias("message"))
    return own.unionByName(lost).unionByName(repeated)


def excluded_phrases(texts: DataFrame, phrases: DataFrame, most: int = 4) -> DataFrame:
    """text_id, phrase, category: excluded phrases that stand in a text as whole words, or anywhere in it for unspaced scripts. texts: text_id, text (normalised); phrases: phrase, category."""
    from lexiloom.functions.text import tokens, windows
    from lexiloom.operators.locale_search import UNSPACED

    spaced = texts.select("text_id", F.explode(F.array_distinct(windows(tokens(F.col("text")), most))).alias("phrase")).join(phrases.filter(~F.col("phrase").rlike(UNSPACED)), "phrase")
    unspaced = phrases.filter(F.col("phrase").rlike(UNSPACED)).withColumn("size", F.length("phrase"))
    runs = texts.filter(F.col("text").rlike(UNSPACED)).join(F.broadcast(unspaced.select("size").distinct())).select("text_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - F.col("size") + 1, F.lit(1))), lambda i: F.substring("text", i, F.col("size"))))).alias("phrase"))
    return spaced.unionByName(runs.join(unspaced.drop("size"), "phrase")).select("text_id", "phrase", "category").distinct()


def occurrences(sources: DataFrame, first: str, last: str) -> DataFrame:
    """source, from, to, shows: the days on which dated and yearly sources fall in a range, and the day they are first shown.

    sources: source, month_day or date, days (length), lead (days shown before).
    """
    years = F.sequence(F.year(F.to_date(F.lit(first))) - 1, F.year(F.to_date(F.lit(last))) + 1)
    yearly = F.transform(years, lambda y: F.try_to_date(F.concat_ws("-", y.cast("string"), F.col("month_day")), "yyyy-MM-dd"))
    starts = F.when(F.col("date").isNotNull(), F.array(F.to_date("date"))).otherwise(yearly)
    rows = sources.select("source", "days", "lead", F.explode(starts).alias("start")).filter("start is not null")
    end, shows = F.date_add("start", F.col("days") - 1), F.date_sub("start", F.col("lead"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.filter((end >= F.to_date(F.lit(first))) & (shows <= F.to_date(F.lit(last)))).select("source", text("start").alias("from"), text(end).alias("to"), text(shows).alias("shows"))


def trigger_owners(records: DataFrame) -> DataFrame:
    """locale, trigger, owner: the first approved record, by id, that has a trigger."""
    each = records.filter("status = 'approved'").select("id", F.explode("triggers").alias("locale", "phrases")).select("id", "locale", F.explode("phrases").alias("trigger"))
    return each.groupBy("locale", "trigger").agg(F.min("id").alias("owner"))


def without_taken(drafts: DataFrame, owners: DataFrame) -> DataFrame:
    """id, locale, triggers: the triggers of drafts that no other record owns."""
    each = drafts.select("id", F.explode("triggers").alias("locale", "phrases")).select("id", "locale", F.posexplode("phrases").alias("at", "trigger"))
    free = each.join(owners, ["locale", "trigger"], "left").filter(F.col("owner").isNull() | (F.col("owner") == F.col("id")))
    return free.groupBy("id", "locale").agg(F.array_sort(F.collect_list(F.struct("at", "trigger")))["trigger"].alias("triggers"))


def merged_live(deployed: DataFrame, live: DataFrame) -> DataFrame:
    """Deployed entries and the live ones that they lack, by kind and id."""
    rows = deployed.unionByName(live.join(deployed.select("id"), "id", "left_anti"))
    return rows.orderBy(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "id")


def imported(known: DataFrame, exported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, conflicts): exported records whose id is free, and ids that are taken by another record (equal ones are no conflict)."""
    print_ = lambda df: df.withColumn("print", F.xxhash64(F.to_json(F.struct(*sorted(known.columns)))))
    a, b = print_(known), print_(exported)
    conflicts = b.select("id", "print").join(a.select("id", F.col("print").alias("old")), "id").filter("print <> old").select("id")
    return exported.join(known.select("id"), "id", "left_anti"), conflicts


def probe_regions(all_regions: list[str]) -> tuple[Column, Column]:
    """A region that a record covers and one that it doesn't, null where there is none."""
    every = F.array(*map(F.lit, sorted(all_regions)))
    world = F.array_contains("regions", F.lit("*"))
    excepted = F.coalesce("except_regions", F.array().cast("array<string>"))
    inside = F.when(world, F.array_except(every, excepted)).otherwise(F.col("regions"))
    outside = F.when(world, F.array_intersect(every, excepted)).otherwise(F.array_except(every, F.col("regions")))
    return F.get(inside, F.lit(0)), F.get(outside, F.lit(0))


def gate(before: DataFrame, after: DataFrame, triggers: DataFrame, within: int = 3) -> DataFrame:
    """query_id, problem: queries whose top result changes though they aren't triggers, and triggers whose items miss the first places.

    before, after: query_id, place, item; triggers: query_id, item.
    """
    tops = [df.filter("place = 1").select("query_id", F.col("item").alias(name)) for df, name in ((before, "was"), (after, "now"))]
    moved = tops[0].join(tops[1], "query_id").filter("was <> now").join(triggers.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("top result changed").alias("problem"))
    shown = after.filter(F.col("place") <= within).join(triggers.select("query_id", "item"), ["query_id", "item"], "left_semi").select("query_id").distinct()
    unseen = triggers.select("query_id").distinct().join(shown, "query_id", "left_anti").select("query_id", F.lit("trigger not among the first").alias("problem"))
    return moved.unionByName(unseen)


def preview(before: DataFrame, after: DataFrame, k: int = 5) -> DataFrame:
    """query_id, was, now, changed: a record's effect on the first results."""
    firsts = lambda df, name: df.filter(F.col("place") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "item")))["item"].alias(name))
    both = firsts(before, "was").join(firsts(after, "now"), "query_id", "full")
    return both.withColumn("changed", ~F.col("was").eqNullSafe(F.col("now")))


def draft_items(hints: DataFrame, hits: DataFrame, catalog: DataFrame, limit: int = 40) -> DataFrame:
    """draft, place, item: hinted items, then search hits (draft, place, item), known ones and each once."""
    rows = hints.select("draft", "item", F.lit(0).alias("tier"), "place").unionByName(hits.select("draft", "item", F.lit(1).alias("tier"), "place"))
    one = rows.join(catalog.select("item"), "item", "left_semi").groupBy("draft", "item").agg(F.min(F.struct("tier", "place")).alias("r"))
    return one.withColumn("place", rank(Window.partitionBy("draft").orderBy("r", "item"))).filter(F.col("place") <= limit).select("draft", "place", "item")
