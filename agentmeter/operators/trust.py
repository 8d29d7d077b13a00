"""Published records: redaction, validation rules, reruns, trust tiers, the scoreboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentmeter.functions import text as tx

# Limits and closed lists of records.
MAX_BYTES, MIN_REPOS, MIN_SUBMITTERS, MAX_SHARE, REPOS_PER_ACCOUNT = 1_000_000, 5, 3, 0.5, 3
OUTCOMES = ("passed", "tests_failed", "timeout", "budget_hit", "agent_error")
ANSWERS = ("SUPPORTED", "NOT SUPPORTED", "NOT PROVEN")
PRIVATE_NAME = r"^(custom|cmd)(-[12])?$"
RATIO_TOLERANCE = 0.05
REQUEST_BUCKETS = ("1-5", "6-20", "21-50", "51+")
NAME, WEEK = r"^[\w.+@\-]{1,60}$", r"^\d{4}-W(0[1-9]|[1-4]\d|5[0-3])$"
SHA, HASH, REPO_ID = "^[0-9a-f]{40}$", "^[0-9a-f]{64}$", "^[0-9a-f]{24}$"
PRIVATE_TEXT = r"https?://|\b[0-9a-fA-F]{40}\b"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f\u200e\u200f\u202a-\u202e\u2066-\u2069]"


def published(runs: DataFrame, urls: DataFrame, home: str) -> DataFrame:
    """runs with local repo paths replaced by urls (repo, url); a row that would still show home fails the job."""
    r = runs.join(urls, "repo", "left").withColumn("repo", F.coalesce("url", "repo")).drop("url")
    leak = F.col("repo").contains(home)
    return r.withColumn("repo", F.when(leak, F.raise_error(F.lit("a local path would be published"))).otherwise(F.col("repo")))


def problems(rules: dict[str, Column]) -> Column:
    """The names of the rules that are broken, in order; a rule that is null is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(fine, F.lit(False)), name) for name, fine in rules.items()]))


def run_rules() -> dict[str, Column]:
    """What a run of an upload must keep; columns are those of the upload's runs and sides."""
    c = F.col
    return {
        "unknown outcome": c("outcome").isin(*OUTCOMES),
        "passed doesn't match outcome": c("passed") == (c("outcome") == "passed"),
        "setup of neither side": (c("setup") == c("baseline")) | (c("setup") == c("challenger")),
        "bad cost": (c("cost_usd") >= 0) & (c("cost_usd") < float("inf")),
        "bad wall time or repeat": (c("wall_s") >= 0) & (c("repeat") >= 0),
        "bad tokens": c("tokens").isNull() | ((F.size("tokens") == 4) & F.forall("tokens", lambda t: t >= 0)),
        "bad energy": c("wh").isNull() | ((F.size("wh") == 2) & (F.get("wh", F.lit(0)) >= 0) & (F.get("wh", F.lit(0)) <= F.get("wh", F.lit(1)))),
        "unknown request bucket": c("requests").isNull() | c("requests").isin(*REQUEST_BUCKETS),
        "commit isn't of its kind": F.when(c("public"), c("commit").rlike(SHA)).otherwise(c("commit").rlike("^[0-9]+$")),
    }


def upload_rules() -> dict[str, Column]:
    """What the head of an upload must keep."""
    c = F.col
    text = F.concat_ws(" ", "baseline", "challenger", F.coalesce("affiliation", F.lit("")))
    return {
        "too large": c("size") <= MAX_BYTES,
        "file name isn't the hash": c("file_name") == c("sha256"),
        "under another submitter": c("author").isNull() | (c("author") == c("submitter")),
        "public isn't said": c("public").isNotNull(),
        "control characters": ~text.rlike(CONTROL),
        "private record with address or commit": c("public") | ~text.rlike(PRIVATE_TEXT),
        "repo_id": F.when(c("repo_id").isNull(), c("public")).otherwise(c("repo_id").rlike(REPO_ID)),
        "setup name": c("baseline").rlike(NAME) & c("challenger").rlike(NAME),
        "week": c("week").rlike(WEEK),
        "affiliation too long": c("affiliation").isNull() | (F.length("affiliation") <= 100),
        "rerun_of": c("rerun_of").isNull() | (c("rerun_of").rlike(HASH) & c("public")),
        "claim or task mode": c("claim_kind").isin("agent", "model", "setup") & c("task_mode").isin("hint", "tests"),
        "counts": (c("superseded_attempts") >= 0) & (c("excluded_commits") >= 0),
        "answer": c("answer").isin(*ANSWERS),
        "cost ratio": c("cost_ratio").isNull() | (c("cost_ratio") > 0),
    }


def validated(uploads: DataFrame, runs: DataFrame) -> DataFrame:
    """(sha256, problems): broken rules of each upload's head, of its runs, and what its runs leave out.

    runs: sha256 and the fields of run_rules. Runs are checked as rows; a complete upload has every commit and repeat once on both sides. Raw files are
    for operators.uploads, which sees fields and types that columns can't show.
    """
    head = uploads.select("sha256", problems(upload_rules()).alias("head"))
    sides = uploads.select("sha256", "baseline", "challenger", "public")
    rules = run_rules()
    late = {name: rules.pop(name) for name in ("setup of neither side", "commit isn't of its kind")}  # what the sides decide
    told = runs.select("sha256", "commit", "setup", "repeat", problems(rules).alias("early"))  # the other fields aren't shuffled
    joined = told.join(sides, "sha256").withColumn("broken", F.concat("early", problems(late)))
    key = ["sha256", "commit", "setup", "repeat"]
    ours = F.coalesce(F.col("setup").isin(F.col("baseline"), F.col("challenger")), F.lit(False))
    sides_of = F.when(F.col("baseline") == F.col("challenger"), 1).otherwise(2)
    once = joined.groupBy(*key).agg(F.count("*").alias("n"), F.flatten(F.collect_list("broken")).alias("broken"), F.max(ours).alias("ours"), F.max(sides_of).alias("sides"))
    per = once.groupBy("sha256").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("broken")))).alias("broken"), F.max("n").alias("most"), F.count_if("ours").alias("keys"),
        (F.size(F.collect_set("commit")) * F.max("sides") * F.size(F.collect_set("repeat"))).alias("full"),  # distinct counts would shuffle once more
    )
    of_runs = F.array_union("broken", F.array_compact(F.array(F.when(F.col("most") > 1, "duplicate run"), F.when(F.col("keys") < F.col("full"), "incomplete"))))
    return head.join(per, "sha256", "left").select("sha256", F.array_union("head", F.coalesce(of_runs, F.array(F.lit("no runs")))).alias("problems"))


def integrity(records: DataFrame, runs: DataFrame, attempts: DataFrame, excluded: DataFrame) -> DataFrame:
    """(sha256, problems, missing, redone, excluded): what can't be right in a record's runs, as 'rule: times', and honest gaps as counts.

    records: sha256, baseline, challenger. runs: sha256, commit, setup, repeat, outcome, passed, cost_usd, agent and requests, an array of arrays of
    four counts. attempts: sha256 of attempts that were made again; excluded: sha256 of commits left out. missing: planned runs (each commit,
    side and repeat that the record has) that aren't there.
    """
    c, names = F.col, [F.col("baseline"), F.col("challenger")]
    rules = {
        "unknown outcome": c("outcome").isin(*OUTCOMES),
        "passed doesn't match outcome": c("passed") == (c("outcome") == "passed"),
        "setup of neither side": c("setup").isin(*names),
        "bad cost": c("cost_usd") >= 0,
        "bad tokens": F.forall("requests", lambda r: (F.size(r) == 4) & F.forall(r, lambda t: t >= 0)),
        "solved without tokens": (c("agent") != "claude") | ~c("passed") | (F.size("requests") > 0),
        "duplicate run": c("copy") == 1,
    }
    late = {name: rules.pop(name) for name in ("setup of neither side", "duplicate run")}  # what the record decides
    broken = lambda fine: ~F.coalesce(fine, F.lit(False))
    flags = {name: f"__broken{i}" for i, name in enumerate(rules)}
    told = runs.select("sha256", "commit", "setup", "repeat", "outcome", *[broken(fine).alias(flags[name]) for name, fine in rules.items()])  # the other fields aren't shuffled
    copy = F.row_number().over(Window.partitionBy("sha256", "commit", "setup", "repeat").orderBy("outcome"))
    joined = told.join(records.select("sha256", *names), "sha256").withColumn("copy", copy)
    planned = F.size(F.collect_set("commit")) * 2 * F.size(F.collect_set("repeat"))  # distinct counts would shuffle once more
    times = {name: F.count_if(flags[name]) for name in rules} | {name: F.count_if(broken(fine)) for name, fine in late.items()}
    listed = F.array_compact(F.array(*[F.when(n > 0, F.concat_ws(": ", F.lit(name), n)) for name, n in times.items()]))
    there = joined.groupBy("sha256").agg(F.sort_array(listed).alias("problems"), (planned - F.count_if((c("copy") == 1) & c("setup").isin(*names))).alias("missing"))
    counted = lambda df, name: df.groupBy("sha256").agg(F.count("*").alias(name))
    out = records.select("sha256")
    for part in (there, counted(attempts, "redone"), counted(excluded, "excluded")):
        out = out.join(part, "sha256", "left")
    return out.fillna(0, ["missing", "redone", "excluded"]).withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))


def record(records: DataFrame, runs: DataFrame, attempts: DataFrame, excluded: DataFrame, secret: str) -> DataFrame:
    """records (sha256, public, ...) with runs, superseded_attempts and excluded_commits as arrays, as they may be published.

    Private fields of runs (run_id, note, repo) are dropped, and commits of private records are hashed with a key of the record's own, derived from the
    submitter's secret and the record's sha256: within a record equal commits have equal hashes, but not across records. The secret is never written.
    Attempts that were made again and commits left out stay visible. A record's runs are a few hundred. Records without any have empty arrays.
    """
    digest = lambda *parts: F.sha2(F.concat_ws(":", *parts).cast("binary"), 256)
    keys = records.select("sha256", "public", F.when(~F.col("public"), digest(F.lit(secret), "sha256")).alias("__key"))
    shown = F.when(F.col("public"), F.col("commit").cast("string")).otherwise(F.substring(digest("__key", F.col("commit").cast("string")), 1, 16))
    out = records
    for rows, name in ((runs, "runs"), (attempts, "superseded_attempts"), (excluded, "excluded_commits")):
        fields = [x for x in rows.columns if x not in ("sha256", "commit", "run_id", "note", "repo")]
        hidden = rows.join(keys, "sha256").select("sha256", F.struct(shown.alias("commit"), *fields).alias("r"))
        listed = hidden.groupBy("sha256").agg(F.sort_array(F.collect_list("r")).alias(name))
        out = out.join(listed, "sha256", "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out


def rechecked(claims: DataFrame) -> DataFrame:
    """(sha256, problems): where an upload's answer and ratio don't follow from its runs, give or take rounding.

    claims: sha256, answer, cost_ratio, energy, same_model, b_ and c_ solved, solve_rate and cents_per_solved.
    """
    again = F.col("c_cents_per_solved") / F.col("b_cents_per_solved")
    supported = F.col("answer") == "SUPPORTED"
    both = F.col("b_cents_per_solved").isNotNull() & F.col("c_cents_per_solved").isNotNull()
    close = F.abs(again - F.col("cost_ratio")) <= F.greatest(F.lit(1.0), F.col("cost_ratio")) * RATIO_TOLERANCE
    rules = {
        "energy verdict of other models": F.col("energy").isNotNull() == F.col("same_model"),
        "supported but solves fewer": ~supported | ((F.col("c_solved") > 0) & (F.col("b_solve_rate") - F.col("c_solve_rate") <= 0.10)),
        "cost ratio doesn't match": F.when(both, F.coalesce(close, F.lit(False))).otherwise(F.col("cost_ratio").isNull()),
        "supported without less energy": ~(supported & F.col("same_model")) | (F.coalesce("energy", F.lit("")) == "uses less"),
        "supported without lower cost": ~(supported & ~F.col("same_model")) | F.coalesce(F.col("cost_ratio") <= 0.90, F.lit(False)),
    }
    return claims.select("sha256", problems(rules).alias("problems"))


def owners(records: DataFrame) -> DataFrame:
    """(repo_id, owner): who first submitted a repo; another's record of it is a problem."""
    return records.groupBy("repo_id").agg(F.min_by("submitter", F.struct("week", "sha256")).alias("owner"))


def commit_set(commit: str) -> Column:
    """The different commits of a record's runs, in order, by aggregation; they are a few hundred."""
    return F.array_sort(F.collect_set(commit))


def with_key(records: DataFrame) -> DataFrame:
    """records, which have their set of commits, with key in its place: setups, task mode and commits, as text."""
    return records.withColumn("key", F.to_json(F.struct("baseline", "challenger", "task_mode", "commits"))).drop("commits")


def rerun_key(records: DataFrame, runs: DataFrame) -> DataFrame:
    """with_key of records whose runs (sha256, commit) are given."""
    return with_key(records.join(runs.groupBy("sha256").agg(commit_set("commit").alias("commits")), "sha256", "left"))


def reruns(records: DataFrame) -> DataFrame:
    """(target, sha256, answer) of records that rerun another's public record: named by hash, another submitter, the same key. records: with key."""
    a = records.where("rerun_of IS NOT NULL AND public").select("sha256", F.col("submitter").alias("by"), F.col("rerun_of").alias("target"), "key", "answer")
    t = records.where("public").select(F.col("sha256").alias("target"), "submitter", F.col("key").alias("target_key"))
    return a.join(t, "target").where("by <> submitter AND key = target_key").select("target", "sha256", "answer")


def tiers(records: DataFrame) -> DataFrame:
    """records with tier: rerun, disputed, reproduced or self-reported. A record's sha256 is its own, and rerun_of, public and key say which records rerun it, as in reruns.

    Records are shuffled once: they meet a row for each record and key that public reruns name. Of a key only a digest is compared. Each
    answer has its first and last submitter by name, as one of them differs from the record's own if any does, so a record with many
    reruns weighs no more than others.
    """
    mark = F.substring(F.unhex(F.sha2("key", 256)), F.lit(1), F.lit(16))  # 128 bits
    named = records.where("rerun_of IS NOT NULL AND public").select(F.col("rerun_of").alias("sha256"), mark.alias("__mark"), "submitter", "answer")
    by_answer = named.groupBy("sha256", "__mark", "answer").agg(F.min("submitter").alias("first"), F.max("submitter").alias("last"))
    told = by_answer.groupBy("sha256", "__mark").agg(F.collect_list(F.struct("answer", "first", "last")).alias("__told"))
    others = F.filter("__told", lambda t: (t["first"] != F.col("submitter")) | (t["last"] != F.col("submitter")))
    against = F.when(F.col("public"), F.array_max(F.transform(others, lambda t: t["answer"] != F.col("answer"))))
    tier = F.when(F.col("rerun_of").isNotNull(), "rerun").when(F.col("__against"), "disputed").when(F.col("__against").isNotNull(), "reproduced").otherwise("self-reported")
    met = records.withColumn("__mark", mark).join(told, ["sha256", "__mark"], "left")
    return met.withColumn("__against", against).withColumn("tier", tier).drop("__mark", "__told", "__against")


def newest(records: DataFrame, by: list[str]) -> DataFrame:
    """The newest record of each submitter and repo."""
    w = Window.partitionBy(*by, "submitter", "repo_id").orderBy(F.col("week").desc(), "sha256")
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def at_most(records: DataFrame, by: list[str], n: int = REPOS_PER_ACCOUNT) -> DataFrame:
    """At most n repos of each submitter, the newest ones."""
    w = Window.partitionBy(*by, "submitter").orderBy(F.col("week").desc(), "repo_id", "sha256")
    return records.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def scoreboard(tiered: DataFrame, vendors: DataFrame) -> DataFrame:
    """By tier and claim: repos, submitters, answers, median ratio and solve difference, and shown: whether there is enough.

    tiered: records with tier, cost_ratio, solve_diff, n_runs. vendors: (challenger, submitter); their claims count once reproduced.
    Reruns, disputed records and private names are left out before the newest ones are taken.
    """
    v = F.broadcast(vendors.withColumn("__vendor", F.lit(True)))  # a list of names; by claim and submitter, records would lie in a few tasks
    usable = tiered.where(F.col("tier").isin("reproduced", "self-reported") & ~F.col("baseline").rlike(PRIVATE_NAME) & ~F.col("challenger").rlike(PRIVATE_NAME))
    usable = usable.join(v, ["challenger", "submitter"], "left").where("__vendor IS NULL OR tier = 'reproduced'").drop("__vendor")
    by = ["tier", "baseline", "challenger"]
    kept = at_most(newest(usable, by), by)
    each = Window.partitionBy(*by, "submitter")
    kept = kept.withColumns({"__runs": F.sum("n_runs").over(each), "__first": F.row_number().over(each.orderBy("sha256")) == 1})  # a submitter's runs, and one of the submitter's rows
    share = [F.count_if("__first").alias("submitters"), F.max("__runs").alias("most"), F.sum("n_runs").alias("runs")]
    answers = [F.count_if(F.col("answer") == a).alias(a.lower().replace(" ", "_")) for a in ANSWERS]
    g = kept.groupBy(*by).agg(F.count("*").alias("repos"), *answers, F.median("cost_ratio").alias("median_cost_ratio"), F.median("solve_diff").alias("median_solve_diff"), *share)
    enough = (F.col("repos") >= MIN_REPOS) & (F.col("submitters") >= MIN_SUBMITTERS) & (F.col("most") <= F.col("runs") * MAX_SHARE)
    return g.withColumn("shown", enough).drop("most", "runs")


def upload_view(records: DataFrame) -> DataFrame:
    """Runs of private records as others may see them: rounded, named from the catalog, commits numbered as they first come. One shuffle by record serves both windows."""
    first = Window.partitionBy("sha256", "commit")
    numbered = records.repartition("sha256").withColumn("__first", F.min("pos").over(first)).withColumn("commit_no", F.dense_rank().over(Window.partitionBy("sha256").orderBy("__first")).cast("long") - 1)
    return numbered.select(
        "sha256", "pos", "commit_no", tx.public_name(F.col("setup"), F.col("agent")).alias("setup"), tx.two_figures(F.col("tokens")).alias("tokens"), (F.bround(F.col("wall_s") / 10, 0) * 10).cast("long").alias("wall_s"), F.bround("cost_usd", 2).alias("cost_usd"), tx.count_bucket(F.col("requests")).alias("requests")
    )


def evidence(verified: DataFrame, picks: DataFrame) -> DataFrame:
    """Evidence for a default model, newest first: supported records of one vendor's models, and picks of runs. Columns kind, model, week, id."""
    v = verified.where("answer = 'SUPPORTED' AND same_vendor").select(F.lit("verified").alias("kind"), "model", "week", "id")
    p = picks.where("picked").select(F.lit("picked").alias("kind"), "model", "week", "id")
    both = v.unionByName(p)
    w = Window.partitionBy("model").orderBy(F.col("week").desc(), "kind", "id")
    return both.withColumn("rank", F.row_number().over(w).cast("long"))
