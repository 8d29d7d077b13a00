"""What became of a commit: kept, squashed, discarded, reverted, reworked, lasting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keyed lines and the facts of commits.
Read = tuple[DataFrame, DataFrame]
# Days until a commit is judged kept, that a squash may follow it, and that a change must last; the share of reworked lines.
KEEP_DAYS, SQUASH_DAYS, MATURE_DAYS, REWORK_SHARE = 7, 30, 30, 0.30
#: Days of a span of time, no less than what is looked ahead; longs of a commit's bitmap of lines.
SPAN, WORDS = 30, 16


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL {n} DAY")


def keyed(lines: DataFrame, commits: DataFrame, on_ref: DataFrame) -> DataFrame:
    """lines as digests with their commit's time, once each: repo, sha, ts, up (on the ref), plus, h and g of (path, line), p and q of the line without white space.

    lines: (repo, sha, path, side, line); commits: (repo, sha, ts). All that is asked of lines is asked of these rows of fixed width; texts go no further.
    """
    bare, plus = F.regexp_replace("line", r"\s+", ""), F.col("side") == "+"
    two = lambda *c: (F.xxhash64(*c), F.xxhash64(F.lit(1), *c))
    (h, g), (p, q) = two("path", "line"), two("path", "side", bare)
    rows = lines.select("repo", "sha", plus.alias("plus"), h.alias("h"), g.alias("g"), p.alias("p"), q.alias("q")).distinct()
    timed = commits.select("repo", "sha", "ts").join(on_ref.select("repo", "sha").distinct().withColumn("up", F.lit(True)), ["repo", "sha"], "left")
    return rows.join(timed.withColumn("up", F.coalesce("up", F.lit(False))), ["repo", "sha"])


def patch_ids(rows: DataFrame) -> DataFrame:
    """(repo, sha, up, patch_id) of keyed rows: a digest of a commit's changed lines that doesn't depend on their order.

    White space in lines doesn't count. Hashes are added and xored, so nothing is collected.
    """
    digest = F.struct(F.count("*").alias("n"), F.sum(F.col("p").cast("decimal(38,0)")).alias("s"), F.bit_xor("q").alias("x"))
    return rows.select("repo", "sha", "up", "p", "q").distinct().groupBy("repo", "sha", "up").agg(digest.alias("patch_id"))


def picked(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidates (repo, sha) whose patch some commit on the ref has too; rows: keyed."""
    ids = patch_ids(rows)
    there = ids.where("up").select("repo", "patch_id").distinct()
    return ids.join(candidates.select("repo", "sha"), ["repo", "sha"], "left_semi").join(there, ["repo", "patch_id"], "left_semi").select("repo", "sha")


def _slot(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / (SPAN * 86_400))


def facts(rows: DataFrame) -> DataFrame:
    """What the lines of a commit come to, from one shuffle of keyed rows by line.

    repo, sha, ts; added: its added lines; gone: those that commits on the ref removed within MATURE_DAYS after it; known: those that
    commits on the ref added within SQUASH_DAYS from it on; hook: the one of its lines that the fewest such commits add; seals: a bitmap of its lines.
    A line's rows lie in the span of their time, and those of the ref in the span before as well, as nothing looks further ahead: a
    line that is everywhere is spread over time, and a frame that grows backwards in time costs its rows.
    """
    line = rows.withColumn("own", F.lit(True)).withColumn("slot", _slot(F.col("ts")))
    ahead = line.where("up").withColumn("own", F.lit(False)).withColumn("slot", F.col("slot") - 1)
    us, day = F.unix_micros("ts"), 86_400_000_000
    latest = Window.partitionBy("repo", "h", "g", "slot").orderBy(us.desc())
    on, after = latest.rangeBetween(Window.unboundedPreceding, 0), latest.rangeBetween(Window.unboundedPreceding, -1)
    added = F.col("up") & F.col("plus")
    seen = line.unionByName(ahead).withColumns({
        "removed": F.min(F.when(F.col("up") & ~F.col("plus"), us)).over(after), "held": F.min(F.when(added, us)).over(on), "often": F.count_if(added).over(on),
    }).where("own AND plus")
    bit = F.expr("shiftleft(1L, CAST(pmod(g, 64) AS INT))")
    seals = F.array(*[F.coalesce(F.bit_or(F.when(F.pmod("h", F.lit(WORDS)) == i, bit)), F.lit(0).cast("long")) for i in range(WORDS)])
    return seen.groupBy("repo", "sha", "ts", "up").agg(
        F.count("*").alias("added"), F.count_if(F.col("removed") <= us + MATURE_DAYS * day).alias("gone"), F.count_if(F.col("held") <= us + SQUASH_DAYS * day).alias("known"),
        F.min_by(F.struct("h", "g"), F.struct("often", "h", "g")).alias("hook"), seals.alias("seals"),
    )


def look(lines: DataFrame, commits: DataFrame, on_ref: DataFrame) -> Read:
    """keyed rows and facts, in this order. A caller that asks for several things writes both and hands them on as read."""
    rows = keyed(lines, commits, on_ref)
    return rows, facts(rows)


def rework_share(commits: DataFrame, lines: DataFrame, on_ref: DataFrame, read: Read | None = None) -> DataFrame:
    """(repo, sha, added, gone): added lines, and those that commits on the ref removed within MATURE_DAYS after it."""
    return (read or look(lines, commits, on_ref))[1].select("repo", "sha", "added", "gone")


def squashed(candidates: DataFrame, lines: DataFrame, commits: DataFrame, on_ref: DataFrame, read: Read | None = None) -> DataFrame:
    """Candidates (repo, sha) all of whose added lines one later commit on the ref added as well, within SQUASH_DAYS.

    Only candidates whose lines are all on the ref in that time are tried. They meet the commits that hold their rarest line, and those
    whose bitmap lacks one of theirs are ruled out; lines are compared for what is left.
    """
    rows, known = read or look(lines, commits, on_ref)
    own = known.where("known = added").join(candidates.select("repo", "sha"), ["repo", "sha"], "left_semi")
    more = own.where("added > 1").select("repo", "sha", "ts", "added", "seals", "hook.h", "hook.g").withColumn("slot", F.explode(F.array(_slot(F.col("ts")), _slot(F.col("ts")) + 1)))
    adding = rows.where("up AND plus").select("repo", F.col("sha").alias("holder"), F.col("ts").alias("held"), "h", "g")
    met = more.join(adding.withColumn("slot", _slot(F.col("held"))), ["repo", "h", "g", "slot"]).where((F.col("held") >= F.col("ts")) & (F.col("held") <= F.col("ts") + _days(SQUASH_DAYS)))
    theirs = known.where("up").select("repo", F.col("sha").alias("holder"), F.col("seals").alias("held_seals"), F.col("added").alias("holds"))
    lacks = F.exists(F.zip_with("seals", "held_seals", lambda a, b: a.bitwiseAND(F.bitwise_not(b)) != 0), lambda x: x)
    pairs = met.join(theirs, ["repo", "holder"]).where((F.col("holds") >= F.col("added")) & ~lacks).select("repo", "sha", "holder", "added")
    parts = pairs.join(rows.where("plus").select("repo", "sha", "h", "g"), ["repo", "sha"])
    full = parts.join(adding.select("repo", "holder", "h", "g"), ["repo", "holder", "h", "g"], "left_semi").groupBy("repo", "sha", "holder", "added").agg(F.count("*").alias("n")).where("n = added")
    return own.where("added = 1").select("repo", "sha").unionByName(full.select("repo", "sha").distinct())


def statuses(commits: DataFrame, history: DataFrame, lines: DataFrame, on_ref: DataFrame, refs: DataFrame, now: Column, read: Read | None = None) -> DataFrame:
    """(repo, sha, status) of commits (repo, sha, ts). refs: (repo, ref_updated); repos without one are 'git error'. history: all commits, with times.

    Only commits off the ref and old enough are matched by patch and by lines.
    """
    rows, known = read = read or look(lines, history, on_ref)
    old = commits.where(F.col("ts") + _days(KEEP_DAYS) <= now)
    candidates = old.join(on_ref, ["repo", "sha"], "left_anti").select("repo", "sha")
    flag = lambda df, name: df.select("repo", "sha").distinct().withColumn(name, F.lit(True))
    same = flag(picked(candidates, rows), "picked").join(flag(squashed(candidates, lines, history, on_ref, read), "squash"), ["repo", "sha"], "full")
    joined = (
        commits.join(refs, "repo", "left").join(flag(on_ref, "on_ref"), ["repo", "sha"], "left").join(same, ["repo", "sha"], "left")
        .join(known.select("repo", "sha", F.lit(True).alias("meaningful")), ["repo", "sha"], "left")
    )
    status = (
        F.when(F.col("ref_updated").isNull(), "git error").when(F.col("ts") + _days(KEEP_DAYS) > now, "pending").when(F.col("on_ref"), "kept").when(F.col("picked"), "kept")
        .when(F.col("squash"), "kept (squash)").when(F.col("ref_updated") < F.col("ts") + _days(KEEP_DAYS), "unknown (stale)").when(F.col("meaningful").isNull(), "unknown (squash)")
        .otherwise("discarded")
    )
    return joined.select("repo", "sha", status.alias("status"))


def reverted(bodies: DataFrame) -> DataFrame:
    """Distinct (repo, hash) that messages (repo, body) say they revert: any 40 hex digits in such a message."""
    found = bodies.where(F.col("body").contains("This reverts commit")).select("repo", F.explode(F.regexp_extract_all("body", F.lit(r"(?:^|[\s.])([0-9a-f]{40})(?=$|[\s.])"), 1)).alias("hash"))
    return found.distinct()


def judged(ledger: DataFrame, status: DataFrame, reverts: DataFrame, rework: DataFrame, now: Column) -> DataFrame:
    """ledger (repo, sha, hash, ts, ...) with outcome: too new, unreadable, reverted, not kept, reworked or durable, in that order."""
    back = reverts.withColumn("is_reverted", F.lit(True))
    j = ledger.join(status, ["repo", "sha"], "left").join(back, ["repo", "hash"], "left").join(rework, ["repo", "sha"], "left")
    outcome = (
        F.when(F.col("ts") + _days(MATURE_DAYS) > now, "too new").when(F.col("status") == "git error", "unreadable").when(F.col("is_reverted"), "reverted")
        .when(~F.coalesce(F.col("status").startswith("kept"), F.lit(False)), "not kept").when(F.col("gone") >= F.col("added") * REWORK_SHARE, "reworked").otherwise("durable")
    )
    return j.select(*[F.col(c) for c in ledger.columns], outcome.alias("outcome"))


def judgement(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, cost of a lasting change and waste, in whole units of cost. Null where nothing is there to divide by."""
    counts = [F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_")) for o in ("durable", "reverted", "reworked", "not kept", "too new", "unreadable")]
    is_judged = F.col("outcome").isin("durable", "reverted", "reworked", "not kept")
    spent = F.coalesce(F.sum(F.when(is_judged, F.col("cents"))), F.lit(0)).alias("cents")
    lasting = F.coalesce(F.sum(F.when(F.col("outcome") == "durable", F.col("cents"))), F.lit(0)).alias("durable_cents")
    first = F.min(F.when(F.col("outcome") == "too new", F.col("ts"))).alias("first_judgeable_ts")
    g = (rows.groupBy(*by) if by else rows).agg(*counts, spent, lasting, first)
    return g.withColumn("cents_per_durable", F.try_divide("cents", "durable")).withColumn("waste_ratio", F.try_divide(F.col("cents") - F.col("durable_cents"), "cents"))


def default_ref(refs: DataFrame) -> DataFrame:
    """(repo, ref, updated): the candidate ref with the newest tip, the first by name among equals; updated is the later of tip and reflog."""
    order = Window.partitionBy("repo").orderBy(F.col("tip_ts").desc(), "ref")
    first = refs.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return first.select("repo", "ref", F.greatest("tip_ts", "reflog_ts").alias("updated"))
