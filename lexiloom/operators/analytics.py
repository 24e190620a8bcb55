"""Aggregations over the search log: totals, top lists, privacy floors, trends and usage.

All take and give DataFrames. Sums are combined before each shuffle; accounts are counted exactly,
as the privacy floors depend on it. Lists are cut after their filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The privacy floor of published queries: distinct accounts and searches.
MIN_ACCOUNTS, MIN_SEARCHES = 3, 10
RECENT_DAYS, BASE_DAYS = 7, 28
ALL = "*"


def rank(window) -> Column:
    return F.row_number().over(window).cast("long")


def between(log: DataFrame, first: str, last: str) -> DataFrame:
    return log.filter(F.col("day").between(first, last))


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Filters by the columns whose wanted value is given."""
    return reduce(lambda d, kv: d if kv[1] is None else d.filter(F.col(kv[0]) == kv[1]), wanted.items(), df)


def daily_totals(log: DataFrame, first: str, last: str) -> DataFrame:
    """day, searches, misses for every day of the window, zero where the log has none."""
    days = log.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    sums = between(log, first, last).groupBy("day").agg(F.sum("searches").alias("searches"), F.sum("misses").alias("misses"))
    return days.join(sums, "day", "left").fillna(0, ["searches", "misses"])


def top_queries(log: DataFrame, floor: int = 5, limit: int = 20, misses: bool = False) -> DataFrame:
    """query and its sums, most searched (or most missed) first, of queries with at least `floor` searches."""
    sums = log.groupBy("query").agg(F.sum("searches").alias("searches"), F.sum("misses").alias("misses")).filter(F.col("searches") >= floor)
    if misses:
        sums = sums.filter("misses > 0")
    return sums.orderBy(F.desc("misses" if misses else "searches"), "query").limit(limit)


def breakdown(log: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """A column's values with their searches, misses and share of the searches."""
    sums = log.groupBy(column).agg(F.sum("searches").alias("searches"), F.sum("misses").alias("misses")).orderBy(F.desc("searches"), column).limit(limit)
    return sums.withColumn("share", F.round(F.col("searches") / F.sum("searches").over(Window.partitionBy(F.lit(0))), 6))


def k_anonymous(log: DataFrame, account: Column, keys: list[str], accounts: int = MIN_ACCOUNTS, searches: int = MIN_SEARCHES) -> DataFrame:
    """Groups by `keys` with enough distinct accounts and searches. Accounts are made distinct before they are counted, so a hot group is spread over tasks."""
    by_account = log.withColumn("account", account).groupBy(*keys, "account").agg(F.sum("searches").alias("searches"))
    found = by_account.groupBy(*keys).agg(F.count("account").alias("accounts"), F.sum("searches").alias("searches"))
    return found.filter((F.col("accounts") >= accounts) & (F.col("searches") >= searches))


def windowed_counts(log: DataFrame, account: Column, windows: dict[str, tuple[str, str]], unknown: str = "XX") -> DataFrame:
    """window, locale, country, query, accounts, searches: counts in each window (inclusive days), by country without the unknown one, and over all countries as `*`.

    One scan: a row is dealt to the windows that hold its day and to its country and
    `*`, and summed by account before it is shuffled.
    """
    inside = [F.when(F.col("day").between(first, last), F.lit(name)) for name, (first, last) in windows.items()]
    places = F.array_compact(F.array(F.when(F.col("country") != unknown, F.col("country")), F.lit(ALL)))
    days = [day for window in windows.values() for day in window]
    rows = between(log, min(days), max(days)).withColumn("account", account).withColumn("window", F.explode(F.array_compact(F.array(*inside)))).withColumn("country", F.explode(places))
    keys = ["window", "locale", "country", "query"]
    by_account = rows.groupBy(*keys, "account").agg(F.sum("searches").alias("searches"))
    return by_account.groupBy(*keys).agg(F.count("account").alias("accounts"), F.sum("searches").alias("searches"))


def recent_counts(log: DataFrame, account: Column, first: str, last: str, unknown: str = "XX") -> DataFrame:
    """locale, country, query, accounts, searches of a window, of groups over the privacy floor."""
    found = windowed_counts(log, account, {"recent": (first, last)}, unknown).drop("window")
    return found.filter((F.col("accounts") >= MIN_ACCOUNTS) & (F.col("searches") >= MIN_SEARCHES))


def trend_windows(run_day: str) -> dict[str, tuple[str, str] | list[str]]:
    """Days before a run: the recent week, the four weeks before it, and the earlier runs whose weeks those are."""
    from datetime import date, timedelta

    run = date.fromisoformat(run_day)
    day = lambda n: (run - timedelta(days=n)).isoformat()
    return {"recent": (day(RECENT_DAYS), day(1)), "baseline": (day(RECENT_DAYS + BASE_DAYS), day(RECENT_DAYS + 1)), "history": [day(7 * k) for k in range(1, 5)]}


def trend_score(searches: Column, baseline: Column) -> Column:
    return F.round((searches / RECENT_DAYS + 1) / (baseline / BASE_DAYS + 1), 2)


def regional_trends(log: DataFrame, account: Column, run_day: str) -> DataFrame:
    """locale, country, query, score, searches, accounts of the week before a run.

    The baseline is what the log still holds of the four weeks before, or what the
    four runs then published of them, whichever is more. All six windows come from
    one scan of the log.
    """
    at = trend_windows(run_day)
    earlier = {f"run {day}": trend_windows(day)["recent"] for day in at["history"]}
    counts = windowed_counts(log, account, {"recent": at["recent"], "baseline": at["baseline"], **earlier})
    public = (F.col("accounts") >= MIN_ACCOUNTS) & (F.col("searches") >= MIN_SEARCHES)
    recent, logged = (F.max(F.when(test, F.col("searches"))) for test in ((F.col("window") == "recent") & public, F.col("window") == "baseline"))
    remembered = F.sum(F.when(F.col("window").startswith("run ") & public, F.col("searches")))
    accounts = F.max(F.when(F.col("window") == "recent", F.col("accounts")))
    one = counts.groupBy("locale", "country", "query").agg(recent.alias("searches"), accounts.alias("accounts"), F.greatest(F.coalesce(logged, F.lit(0)), F.coalesce(remembered, F.lit(0))).alias("baseline"))
    return one.filter("searches is not null").select("locale", "country", "query", trend_score(F.col("searches"), F.col("baseline")).alias("score"), "searches", "accounts")


def capped(trends: DataFrame, per_region: int = 500, overall: int = 10_000) -> DataFrame:
    """The most searched rows: so many a region, then so many in all. A row over its region's cap takes nothing of the whole."""
    region = Window.partitionBy("locale", "country").orderBy(F.desc("searches"), "query")
    return trends.withColumn("place", rank(region)).filter(F.col("place") <= per_region).drop("place").orderBy(F.desc("searches"), "locale", "country", "query").limit(overall)


def rising(trends: DataFrame, top: int = 3) -> DataFrame:
    """The top rows of each region by score, with the region's best score."""
    region = Window.partitionBy("locale", "country")
    placed = trends.withColumn("place", rank(region.orderBy(F.desc("score"), F.desc("searches"), "query"))).withColumn("best", F.max("score").over(region))
    return placed.filter(F.col("place") <= top).select("locale", "country", "place", "query", "score", "best")


def trend_regions(trends: DataFrame) -> DataFrame:
    """Per locale and query the sorted regions that it trends in, `*` alone if it trends in the whole locale."""
    found = trends.groupBy("locale", "query").agg(F.array_sort(F.collect_set("country")).alias("regions"))
    return found.select("locale", "query", F.when(F.array_contains("regions", ALL), F.lit(ALL)).otherwise(F.concat_ws(",", "regions")).alias("regions"))


def query_log_merged(log: DataFrame, account: Column, top: int = 100) -> DataFrame:
    """query, n, locales (sorted, comma-joined) of queries over the privacy floor, most searched first."""
    kept = k_anonymous(log, account, ["query"]).select("query", F.col("searches").alias("n"))
    locales = log.groupBy("query").agg(F.concat_ws(",", F.array_sort(F.collect_set("locale"))).alias("locales"))
    return kept.join(locales, "query").orderBy(F.desc("n"), "query").limit(top)


def usage_share(usage: DataFrame, account: str, metric: str, mine: Column) -> DataFrame:
    """Per account and metric: the total, and the part of it where `mine` holds."""
    return usage.groupBy(account, metric).agg(F.sum("count").alias("total"), F.sum(F.when(mine, F.col("count")).otherwise(0)).alias("mine"))


def with_account_total(usage: DataFrame, keys: list[str]) -> DataFrame:
    """usage with the sum over all rows of its keys."""
    return usage.join(usage.groupBy(*keys).agg(F.sum("count").alias("account_total")), keys)


def threshold_crossings(usage: DataFrame, account: str, at: str, limit: int, percents: tuple[int, ...] = (80, 100)) -> DataFrame:
    """account, at, percent, total: where the running total of an account first reaches a share of its limit."""
    total = F.sum("count").over(Window.partitionBy(account).orderBy(at))
    marks = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.lit(-(-limit * p // 100)).alias("mark")) for p in percents]))
    rows = usage.withColumn("total", total).withColumn("m", marks)
    return rows.filter((F.col("total") >= F.col("m.mark")) & (F.col("total") - F.col("count") < F.col("m.mark"))).select(account, at, "m.percent", "total")


def outcomes(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Per day, how many events of each kind."""
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds])


def cancelled(events: DataFrame, within_seconds: int = 3600) -> DataFrame:
    """Per user, how many of their events were overtaken by a later event of another kind within some seconds."""
    turn = Window.partitionBy("user_id").orderBy("ts", "event_id")
    after = events.withColumn("next_ts", F.lead("ts").over(turn)).withColumn("next_type", F.lead("event_type").over(turn))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    soon = micros("next_ts") - micros("ts") < within_seconds * 1_000_000
    return after.groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_if(soon & (F.col("next_type") != F.col("event_type"))).alias("n_cancelled"))


def weighted_counts(points: DataFrame, key: str, weight: str, least: float, limit: int) -> DataFrame:
    """A key's sampled points counted by their weights (one over the share that is kept), if enough, most first."""
    return points.groupBy(key).agg(F.sum(weight).alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), key).limit(limit)


#: Fixed values of client reports.
LEAST_SAMPLE, MOST_PICKS, ID = 0.001, 50, r"^[0-9A-Za-z-]{1,64}$"
REPORT = "v int, sample double, locale string, counts map<string,long>, picks array<array<string>>"


def reports(raw: DataFrame, text: str = "report") -> tuple[DataFrame, DataFrame]:
    """(reports, refused): client reports, parsed and checked, and the texts that are none."""
    rows = raw.withColumn("r", F.from_json(text, REPORT))
    picks = F.coalesce("r.picks", F.array().cast("array<array<string>>"))
    good = (F.col("r.v") == 1) & F.col("r.sample").between(LEAST_SAMPLE, 1) & F.col("r.counts").isNotNull() & (F.size(picks) <= MOST_PICKS) & F.forall(picks, lambda p: F.forall(p, lambda i: i.rlike(ID)))
    good = good & F.forall(F.map_values("r.counts"), lambda n: n >= 0)
    return rows.filter(F.coalesce(good, F.lit(False))).drop(text), rows.filter(~F.coalesce(good, F.lit(False))).drop("r")


def report_counts(parsed: DataFrame) -> DataFrame:
    """event, n: the reports' counts, each times one over its sample."""
    each = parsed.select((1 / F.col("r.sample")).alias("weight"), F.explode("r.counts").alias("event", "count"))
    return each.groupBy("event").agg(F.round(F.sum(F.col("weight") * F.col("count")), 6).alias("n"))


def legacy_locale(locale: Column) -> Column:
    return F.when(locale == "und", "en").otherwise(locale)


def with_role(rows: DataFrame, members: DataFrame, member: Column) -> DataFrame:
    """rows (account_id, ...) with the role of a member on each account, null without one."""
    own = members.filter(F.col("member_id") == member).select("account_id", "role")
    return rows.join(own, "account_id", "left")


def apps_with_hooks(apps: DataFrame, hooks: DataFrame) -> DataFrame:
    """account_id, app_id: applications with a webhook that isn't revoked, each once."""
    return apps.join(hooks.filter("revoked_at is null").select("app_id").distinct(), "app_id", "left_semi").select("account_id", "app_id").distinct()


def layered_cost(scenarios: DataFrame, prices: dict[str, float]) -> DataFrame:
    """scenarios with dollars per million searches by layer and in all.

    scenarios: device, shard, cache (shares of what reaches a layer that it answers), reactions, images (per search).
    """
    missed = 1 - F.col("device")
    embedded = missed * (1 - F.col("shard"))
    layers = {"shard": missed * prices["read"], "worker": embedded * prices["request"], "embedding": embedded * (1 - F.col("cache")) * prices["embedding"], "reaction": F.col("reactions") * prices["embedding"], "image": F.col("images") * prices["image"]}
    rows = scenarios.select("*", *[F.round(v * 1e6, 6).alias(f"{k}_cost") for k, v in layers.items()])
    return rows.withColumn("cost", F.round(sum((F.col(f"{k}_cost") for k in layers), F.lit(0.0)), 6))


def sensitivity(base: dict[str, float], spread: float, most: float | None = 1.0) -> list[dict]:
    """The base case, and one with each of its figures lower and higher, but at most `most`."""
    cases = [{"case": "base", **base}]
    for name, value in base.items():
        cases += [{"case": f"{name}{sign}", **base, name: max(0.0, value * factor) if most is None else min(most, max(0.0, value * factor))} for sign, factor in (("-", 1 - spread), ("+", 1 + spread))]
    return cases
