"""Roll-ups of receipts and ledgers: ranks, ledgers, notes, teams, weeks, carbon, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentmeter.functions.dims import EMBODIED_G_PER_KWH, GRID_G_PER_KWH

KEPT = ("kept", "kept (squash)")
#: What a typical commit is told by.
MEDIANS = ("wh_low", "wh_high", "usd")
FEW = 1 << 16


def top(df: DataFrame, kind: str, n: int, by: Column) -> DataFrame:
    """The first n commits by an order, as rows (rank_kind, rank, repo, sha). Each partition gives n rows at most."""
    few = df.orderBy(by, "repo", "sha").limit(n)
    order = Window.orderBy(by, "repo", "sha")  # over n rows
    return few.withColumn("rank", F.row_number().over(order).cast("long")).select(F.lit(kind).alias("rank_kind"), "rank", "repo", "sha")


def typical(receipts: DataFrame, least: int = 5) -> DataFrame:
    """One row of exact medians: over kept commits if there are at least so many, else over all with work.

    Of more than FEW commits, approximate quantiles come first, ten times as far from the middle as they can be wrong; values beyond them
    count as the nearer one, so the values that are put in order are the different ones next to the middle, one in 500 of all.
    """
    worked = receipts.where("seen > 0").withColumn("kept", F.col("status").isin(*KEPT))
    ends = lambda c, where: F.percentile_approx(F.when(where, F.col(c)), [0.499, 0.501], 10_000)
    sides = worked.agg(F.count("*").alias("n_all"), F.count_if("kept").alias("n_kept"), *[ends(c, where).alias(f"{c}_{name}") for c in MEDIANS for name, where in (("kept", F.col("kept")), ("all", F.lit(True)))])
    enough = F.col("n_kept") >= least
    chosen = sides.select(enough.alias("enough"), F.when(enough, F.col("n_kept")).otherwise(F.col("n_all")).alias("commits"), *[F.when(enough, F.col(f"{c}_kept")).otherwise(F.col(f"{c}_all")).alias(f"{c}_ends") for c in MEDIANS])
    pool = worked.crossJoin(F.broadcast(chosen)).where(~F.col("enough") | F.col("kept"))  # chosen is one row
    clamped = lambda c: F.greatest(F.least(F.col(c), F.col(f"{c}_ends")[1]), F.col(f"{c}_ends")[0])
    near = lambda c: F.when(F.col("commits") <= FEW, F.col(c)).when(F.col(c).isNotNull(), clamped(c))
    values = pool.select("commits", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), near(c).alias("value")) for c in MEDIANS])).alias("v")).select("commits", "v.*")
    counts = values.groupBy("commits", "name", "value").agg(F.count("value").alias("n"))
    every = Window.partitionBy("name")
    placed = counts.withColumn("upto", F.sum("n").over(every.orderBy("value"))).withColumn("total", F.sum("n").over(every))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("value")))
    middle = placed.groupBy("commits", "name").agg(((at(F.ceil(F.col("total") / 2)) + at(F.floor(F.col("total") / 2) + 1)) / 2).alias("median"))
    return middle.agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in MEDIANS], F.coalesce(F.max("commits"), F.lit(0).cast("long")).alias("commits"))


def discarded_share(receipts: DataFrame) -> DataFrame:
    """One row: the share of energy, by geometric middles, on commits that were discarded, of those with a decided status."""
    lo, hi = F.col("wh_low") + F.col("lead_up_wh_low"), F.col("wh_high") + F.col("lead_up_wh_high")
    decided, gone = F.col("status").isin(*KEPT, "discarded"), F.col("status") == "discarded"
    s = receipts.where(decided).agg(*[F.coalesce(F.sum(F.when(c, x)), F.lit(0.0)).alias(n) for n, c, x in (("gl", gone, lo), ("gh", gone, hi), ("al", F.lit(True), lo), ("ah", F.lit(True), hi))])
    return s.select((F.sqrt(F.col("gl") * F.col("gh")) / F.greatest(F.sqrt(F.col("al") * F.col("ah")), F.lit(1e-12))).alias("share"))


def ledger_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger after new receipts: for each (repo, sha) the new row, unless the old one saw more requests; first_seen stays.

    seen_requests falls back to requests. New rows without requests are skipped; of several for one commit the one that saw the most requests counts (of
    those, one chosen by hash), with the earliest first_seen. changed says whether the row differs from the old one.
    """
    values = [c for c in new.columns if c != "first_seen"]
    fullest = F.max_by(F.struct(*values), F.struct("seen_requests", F.xxhash64(*values))).alias("s")
    one_each = new.where("seen_requests > 0").groupBy("repo", "sha").agg(fullest, F.min("first_seen").alias("first_seen"))
    n = one_each.select("s.*", "first_seen").alias("n")
    o = old.withColumn("seen_requests", F.coalesce("seen_requests", "requests")).alias("o")
    j = o.join(n, (F.col("o.repo") == F.col("n.repo")) & (F.col("o.sha") == F.col("n.sha")), "full")
    keep_old = F.col("n.sha").isNull() | (F.col("o.sha").isNotNull() & (F.col("o.seen_requests") > F.col("n.seen_requests")))
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    chosen = [F.when(keep_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in values]
    return j.select(*chosen, F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"), (~keep_old & differs).alias("changed"))


def valid_notes(raw: DataFrame) -> DataFrame:
    """Notes (repo, sha, note) that are valid: version 1, finite amounts of at least 0, two ends of energy, whole requests.

    A number written as text, or a boolean, is not an amount. Bad notes are dropped, never fatal.
    """
    parsed = raw.select("repo", "sha", F.explode(F.array(F.try_parse_json("note"))).alias("v"))  # generated, so that it is parsed once
    v = F.col("v")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = lambda path: kind(path).rlike(r"^(BIGINT|DOUBLE|DECIMAL)")
    get = lambda path, t: F.try_variant_get(v, path, t)
    fine = lambda path: number(path) & (get(path, "double") >= 0) & (get(path, "double") < float("inf"))
    ok = (get("$.version", "int") == 1) & fine("$.usd") & fine("$.wh[0]") & fine("$.wh[1]") & get("$.wh[2]", "variant").isNull() & (kind("$.requests") == "BIGINT") & (get("$.requests", "long") >= 0)
    return parsed.where(F.coalesce(ok, F.lit(False))).select("repo", "sha", get("$.usd", "double").alias("usd"), get("$.wh[0]", "double").alias("wh_low"), get("$.wh[1]", "double").alias("wh_high"), get("$.requests", "long").alias("requests"), get("$.seen_requests", "long").alias("seen_requests"))


def notes_to_write(receipts: DataFrame, existing: DataFrame, commits: DataFrame, me: DataFrame) -> DataFrame:
    """Note rows for one's own commits that cost energy, unless an existing note saw more requests. me: (repo, author)."""
    own = receipts.join(commits.select("repo", "sha", F.lower(F.col("author").cast("string")).alias("author")), ["repo", "sha"]).join(me.select("repo", F.lower(F.col("author").cast("string")).alias("author")), ["repo", "author"], "left_semi")
    total_low, total_high = F.col("wh_low") + F.col("lead_up_wh_low"), F.col("wh_high") + F.col("lead_up_wh_high")
    rows = own.where(total_high > 0).select("repo", "sha", F.bround(F.col("usd") + F.col("lead_up_usd"), 2).alias("usd"), F.bround(total_low, 1).alias("wh_low"), F.bround(total_high, 1).alias("wh_high"), "requests", "seen", "tier")
    old = existing.select("repo", "sha", F.coalesce("seen_requests", "requests").alias("old_seen"))
    return rows.join(old, ["repo", "sha"], "left").where("old_seen IS NULL OR old_seen <= seen").drop("old_seen")


def iso_week(ts: Column) -> Column:
    """ISO year and week, as 2025-W01."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def weekly(noted: DataFrame) -> DataFrame:
    """noted (repo, ts, author, cents) by ISO week: cents, commits and people."""
    return noted.groupBy("repo", iso_week(F.col("ts")).alias("week")).agg(F.sum("cents").alias("cents"), F.count("*").alias("commits"), F.count_distinct("author").alias("people"))


def merged_weeks(noted: DataFrame, min_group: int) -> DataFrame:
    """Consecutive weeks of a repo merged until min_group people are in each row; a short tail joins the row before it.

    A fold over a repo's weeks, a few hundred at most, numbers the row each belongs to; weeks after the last full row take its number.
    A week of min_group people is full by itself, so only smaller weeks bring their people along.
    """
    dated = noted.select("repo", iso_week(F.col("ts")).alias("week"), "cents", "author")
    people = dated.where("author IS NOT NULL").select("repo", "week", "author").distinct()
    sizes = people.groupBy("repo", "week").agg(F.count("*").alias("n"))
    few = people.join(sizes.where(F.col("n") < min_group), ["repo", "week"], "left_semi").groupBy("repo", "week").agg(F.collect_set("author").alias("who"))
    nobody = F.array().cast(few.schema["who"].dataType)
    totals = dated.groupBy("repo", "week").agg(F.sum("cents").alias("cents"), F.count("*").alias("commits"))
    weeks = totals.join(sizes, ["repo", "week"], "left").join(few, ["repo", "week"], "left").select("repo", "week", "cents", "commits", F.coalesce(F.col("n") >= min_group, F.lit(False)).alias("alone"), F.coalesce("who", nobody).alias("who"))
    who = weeks.schema["who"].dataType.simpleString()
    nothing = F.struct(F.lit(0).alias("row"), F.lit(True).alias("full"), F.array().cast(who).alias("who"), F.array().cast("array<struct<week:string,cents:bigint,commits:bigint,row:int,full:boolean>>").alias("marks"))

    def step(state: Column, week: Column) -> Column:
        people = F.when(state["full"], week["who"]).otherwise(F.array_union(state["who"], week["who"]))
        row, full = state["row"] + state["full"].cast("int"), week["alone"] | (F.size(people) >= min_group)
        mark = F.struct(week["week"].alias("week"), week["cents"].alias("cents"), week["commits"].alias("commits"), row.alias("row"), full.alias("full"))
        return F.struct(row.alias("row"), full.alias("full"), people.alias("who"), F.concat(state["marks"], F.array(mark)).alias("marks"))

    sorted_weeks = F.array_sort(F.collect_list(F.struct("week", "cents", "commits", "alone", "who")))
    marks = weeks.groupBy("repo").agg(sorted_weeks.alias("w")).select("repo", F.aggregate("w", nothing, step, lambda s: s["marks"]).alias("marks"))
    last_full = F.array_max(F.transform(F.filter("marks", lambda m: m["full"]), lambda m: m["row"]))
    numbered = marks.select("repo", last_full.alias("last_full"), F.inline("marks"))
    row = F.least("row", F.coalesce("last_full", "row"))
    return numbered.groupBy("repo", row.alias("row")).agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.sum("cents").alias("cents"), F.sum("commits").alias("commits")).drop("row")


def team(noted: DataFrame, min_group: int) -> DataFrame:
    """Totals of each repo (noted: repo, author, cents, wh_low, wh_high, outcome), suppressed for fewer than min_group people."""
    g = noted.groupBy("repo").agg(
        F.count_distinct("author").alias("contributors"), F.count("*").alias("noted_commits"), F.sum("cents").alias("cents"), F.sum("wh_low").alias("wh_low"), F.sum("wh_high").alias("wh_high"),
        F.count_if(F.col("outcome") == "durable").alias("working"), F.count_if(F.col("outcome") == "too new").alias("too_new"),
    )
    enough = F.col("contributors") >= min_group
    hidden = [F.when(enough, F.col(c)).alias(c) for c in ("noted_commits", "cents", "wh_low", "wh_high", "working", "too_new")]
    return g.select("repo", "contributors", enough.alias("enough"), *hidden)


def branch(receipts: DataFrame, head: DataFrame, base: DataFrame, commits: DataFrame) -> DataFrame:
    """Totals of the commits of a branch: reachable from head, not from base, no merges. head, base: (repo, sha)."""
    own = head.join(base, ["repo", "sha"], "left_anti").join(commits.where("n_parents < 2").select("repo", "sha"), ["repo", "sha"], "left_semi")
    total = receipts.withColumn("lo", F.col("wh_low") + F.col("lead_up_wh_low")).withColumn("hi", F.col("wh_high") + F.col("lead_up_wh_high")).withColumn("cost", F.col("usd") + F.col("lead_up_usd"))
    return own.join(total, ["repo", "sha"], "left").groupBy("repo").agg(
        F.count("*").alias("commits"), F.count_if(F.col("hi") > 0).alias("with_ai"), F.coalesce(F.sum("lo"), F.lit(0.0)).alias("wh_low"), F.coalesce(F.sum("hi"), F.lit(0.0)).alias("wh_high"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("usd")
    )


def carbon(measured: DataFrame, commits: DataFrame, outcomes: DataFrame, grid: float = GRID_G_PER_KWH) -> DataFrame:
    """One row of carbon intensity, grams: in all, per million tokens, per commit and per working change; null without a divisor."""
    e = measured.agg(F.sum("wh_low").alias("wl"), F.sum("wh_high").alias("wh"), F.sum(F.col("fresh_in") + F.col("cache_write") + F.col("cache_read") + F.col("output")).alias("tokens"))
    n = commits.agg(F.count("*").alias("commits"))
    is_judged = F.col("outcome").isin("durable", "reverted", "reworked", "not kept")
    j = outcomes.agg(F.sum(F.when(is_judged, F.col("wh_low"))).alias("jl"), F.sum(F.when(is_judged, F.col("wh_high"))).alias("jh"), F.count_if(F.col("outcome") == "durable").alias("working"))
    low, high = grid + EMBODIED_G_PER_KWH[0], grid + EMBODIED_G_PER_KWH[1]
    g = e.crossJoin(n).crossJoin(j).withColumns({"g_low": F.col("wl") / 1000 * low, "g_high": F.col("wh") / 1000 * high, "jg_low": F.col("jl") / 1000 * low, "jg_high": F.col("jh") / 1000 * high})
    per = lambda name, x, n: [F.try_divide(F.col(f"{x}_{end}"), n).alias(f"{name}_{end}") for end in ("low", "high")]
    return g.select("tokens", "commits", "working", "g_low", "g_high", *per("g_per_mtok", "g", F.col("tokens") / 1e6), *per("g_per_commit", "g", F.col("commits")), *per("g_per_working", "jg", F.col("working")))


def export(receipts: DataFrame, commits: DataFrame, subjects: bool = True, authors: bool = True) -> DataFrame:
    """One line a commit for a CSV file; subjects and authors can be blanked. commits: repo, sha, ts, subject, author."""
    r = receipts.join(commits, ["repo", "sha"])
    lo, hi = F.col("wh_low") + F.col("lead_up_wh_low"), F.col("wh_high") + F.col("lead_up_wh_high")
    return r.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), "repo", F.col("sha").alias("commit"), F.col("author").cast("string").alias("author") if authors else F.lit("").alias("author"),
        F.col("subject") if subjects else F.lit("").alias("subject"), F.col("tier").alias("matched_by"), F.col("requests").alias("ai_requests"),
        F.bround("wh_low", 3).alias("energy_wh_low"), F.bround("wh_high", 3).alias("energy_wh_high"), F.bround("lead_up_wh_low", 3).alias("lead_up_wh_low"), F.bround("lead_up_wh_high", 3).alias("lead_up_wh_high"),
        F.bround(lo / 1000 * GRID_G_PER_KWH, 2).alias("co2_g_low"), F.bround(hi / 1000 * GRID_G_PER_KWH, 2).alias("co2_g_high"), F.bround("usd", 4).alias("usd_api_equivalent"), F.bround("lead_up_usd", 4).alias("lead_up_usd"),
    )


__all__ = ["branch", "carbon", "discarded_share", "export", "iso_week", "ledger_upsert", "merged_weeks", "notes_to_write", "team", "top", "typical", "valid_notes", "weekly"]
