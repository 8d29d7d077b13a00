"""Experiment runs: latest attempts, arms, ratios, bands, picks and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How far below the best solve rate is good enough, differences that count, runs below which a result is tentative.
GOOD_ENOUGH, SOLVE_MARGIN, COST_MARGIN, MIN_RUNS = 0.10, 0.10, 0.10, 20
DEAD = ("harness_error", "account_error")


def latest(records: DataFrame, excluded: DataFrame) -> DataFrame:
    """The last record of each (commit, setup, repeat), without harness and account errors and excluded commits.

    records: ... outcome, line_no; excluded: (commit). Later attempts replace earlier ones of any outcome but the dead ones.
    """
    alive = records.where(~F.col("outcome").isin(*DEAD))
    rest = [c for c in records.columns if c not in ("commit", "setup", "repeat")]
    last = alive.groupBy("commit", "setup", "repeat").agg(F.max_by(F.struct(*rest), "line_no").alias("r")).select("commit", "setup", "repeat", "r.*")
    return last.join(excluded.select("commit").distinct(), "commit", "left_anti")


def superseded(records: DataFrame) -> DataFrame:
    """Records that a later attempt of the same (commit, setup, repeat) replaced."""
    w = Window.partitionBy("commit", "setup", "repeat").orderBy(F.col("line_no").desc())
    return records.withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")


def paired(runs: DataFrame, setups: list[str], only_passed: bool = False) -> DataFrame:
    """Runs of commits that all the setups attempted (or passed)."""
    own = runs.where(F.col("setup").isin(*setups))
    counted = own.where("passed") if only_passed else own
    both = counted.groupBy("repo", "commit").agg(F.count_distinct("setup").alias("n")).where(F.col("n") == len(setups)).select("repo", "commit")
    return own.join(both, ["repo", "commit"], "left_semi")


def arms(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs, solved, cents and tokens by group."""
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if("passed").alias("solved"), F.sum("cents").alias("cents"), F.sum("tokens").alias("tokens"))


def comparison_sums(runs: DataFrame, comparisons: DataFrame) -> DataFrame:
    """For each comparison (id, baseline, challenger) and commit that both sides attempted: sums of each side in b_ and c_ columns.

    All comparisons go through one join and one aggregation. They are a dimension table and are broadcast: a shuffle by setup would give each of the few setups to one task.
    """
    commit = arms(runs, ["repo", "commit", "setup"])
    side = lambda p: F.struct(*[F.coalesce(F.sum(F.when(F.col("setup") == F.col(p), F.col(c))), F.lit(0)).alias(c) for c in ("runs", "solved", "cents", "tokens")]).alias(p[0])
    either = comparisons.withColumn("setup", F.explode(F.array_distinct(F.array("baseline", "challenger"))))
    met = commit.join(F.broadcast(either), "setup")
    g = met.groupBy("id", "repo", "commit").agg(side("baseline"), side("challenger"))
    flat = [F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("b", "c") for c in ("runs", "solved", "cents", "tokens")]
    return g.where("b.runs > 0 AND c.runs > 0").select("id", "repo", "commit", *flat)


SUMS = [f"{p}_{c}" for p in ("b", "c") for c in ("runs", "solved", "cents", "tokens")]


def ratios() -> dict[str, Column]:
    """Challenger over baseline from summed columns: cost per solved, tokens, cost per attempt, solve rate; null without a divisor."""
    d = lambda a, b: F.try_divide(F.col(a), F.col(b))
    has = lambda *names: [F.col(n) > 0 for n in names]

    def when(conditions: list[Column], value: Column) -> Column:
        all_ = conditions[0]
        for c in conditions[1:]:
            all_ = all_ & c
        return F.when(all_, value)

    return {
        "per_solved": when(has("b_solved", "c_solved", "b_cents"), F.try_divide(d("c_cents", "c_solved"), d("b_cents", "b_solved"))),
        "tokens": when(has("b_runs", "c_runs", "b_tokens"), F.try_divide(d("c_tokens", "c_runs"), d("b_tokens", "b_runs"))),
        "per_attempt": when(has("b_runs", "c_runs", "b_cents"), F.try_divide(d("c_cents", "c_runs"), d("b_cents", "b_runs"))),
        "solved": when(has("b_runs", "c_runs", "b_solved"), F.try_divide(d("c_solved", "c_runs"), d("b_solved", "b_runs"))),
    }


def summed(sums: DataFrame, by: list[str]) -> DataFrame:
    return sums.groupBy(*by).agg(F.count("*").alias("commits"), *[F.sum(c).alias(c) for c in SUMS])


def compared(sums: DataFrame, by: list[str]) -> DataFrame:
    """The four ratios by group."""
    s = summed(sums, by)
    return s.select(*by, "commits", *[x.alias(n) for n, x in ratios().items()])


def directions(sums: DataFrame) -> DataFrame:
    """For each comparison: repos, and in how many the challenger is cheaper per solved, and solves less or more; ties are neither."""
    per_repo = summed(sums, ["id", "repo"])
    r = ratios()
    rate_c, rate_b = F.col("c_solved") * F.col("b_runs"), F.col("b_solved") * F.col("c_runs")
    return per_repo.groupBy("id").agg(F.count("*").alias("repos"), F.count_if(r["per_solved"] < 1).alias("cheaper"), F.count_if(rate_c < rate_b).alias("solves_less"), F.count_if(rate_c > rate_b).alias("solves_more"))


def picker(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Setups with cost per solved, and which one to use: the cheapest per solved within GOOD_ENOUGH of the best solve rate."""
    by = by or []
    a = arms(runs, [*by, "setup"]).withColumn("solve_rate", F.col("solved") / F.col("runs")).withColumn("cents_per_solved", F.try_divide("cents", "solved"))
    all_ = Window.partitionBy(*by)  # the setups of a group, a handful
    best, few = F.max("solve_rate").over(all_), F.min("runs").over(all_)
    good = F.col("cents_per_solved").isNotNull() & (F.col("solve_rate") >= best - GOOD_ENOUGH)
    choice = F.min(F.when(good, F.struct("cents_per_solved", "setup"))).over(all_)
    out = a.withColumns({"__choice": choice, "tentative": few < MIN_RUNS})
    return out.withColumn("picked", F.coalesce(F.col("setup") == F.col("__choice.setup"), F.lit(False))).drop("__choice")


def summaries(runs: DataFrame, by: list[str]) -> DataFrame:
    """Each setup's runs, solved and costs; costs are null if any run's cost isn't known."""
    g = runs.groupBy(*by, "setup").agg(F.count("*").alias("runs"), F.count_if("passed").alias("solved"), F.bool_and("cost_known").alias("priced"), F.sum("cents").alias("cents"))
    known = F.when(F.col("priced"), F.col("cents"))
    return g.select(*by, "setup", "runs", "solved", (F.col("solved") / F.col("runs")).alias("solve_rate"), known.alias("cents"), F.try_divide(known, F.col("solved")).alias("cents_per_solved"))


def verdicts(pairs: DataFrame) -> DataFrame:
    """pairs: b_ and c_ columns of summaries (runs, solved, solve_rate, cents_per_solved), energy (null unless the models agree).

    Adds cost_ratio, answer, reasons and tentative. energy is 'uses less', 'uses more', 'not proven' or 'not enough passing commits'.
    """
    ratio = F.when((F.col("b_cents_per_solved") > 0) & (F.col("c_cents_per_solved") > 0), F.col("c_cents_per_solved") / F.col("b_cents_per_solved"))
    p = pairs.withColumns({"cost_ratio": ratio, "fewer": F.col("b_solve_rate") - F.col("c_solve_rate") > SOLVE_MARGIN})
    fewer, r, same = F.col("fewer"), F.col("cost_ratio"), F.col("energy").isNotNull()
    lower, higher = r <= 1 - COST_MARGIN, r >= 1 + COST_MARGIN
    nothing = F.col("c_solved") == 0
    no, yes, open_ = F.lit("NOT SUPPORTED"), F.lit("SUPPORTED"), F.lit("NOT PROVEN")
    answer = (
        F.when(F.coalesce(F.col("b_runs"), F.lit(0)) == 0, open_).when(F.coalesce(F.col("c_runs"), F.lit(0)) == 0, open_).when(nothing, no).when(same & (F.col("energy") == "uses more"), no)
        .when(~same & F.coalesce(higher, F.lit(False)), no).when(fewer, no).when(same & (F.col("energy") == "uses less"), yes).when(~same & F.coalesce(lower, F.lit(False)), yes).otherwise(open_)
    )
    reasons = F.array_compact(F.array(
        F.when(nothing, "solved nothing"), F.when(~nothing & fewer, "solves fewer tasks"),
        F.when(~nothing & same & (F.col("energy") == "uses less") & ~fewer, "uses less energy").when(~nothing & same & (F.col("energy") == "uses more"), "uses more energy").when(~nothing & same & ~fewer, "energy not settled"),
        F.when(~nothing & ~same & r.isNull(), "cost not measurable").when(~nothing & ~same & lower & ~fewer, "lower cost").when(~nothing & ~same & higher, "higher cost").when(~nothing & ~same & ~fewer & ~lower, "cost within a tenth"),
        F.when(~nothing & ~same, "energy not ranked"),
    ))
    return p.withColumns({"answer": answer, "reasons": reasons, "tentative": F.least("b_runs", "c_runs") < MIN_RUNS}).drop("fewer")


def bands(runs: DataFrame) -> DataFrame:
    """(repo, commit, band): easy from 5 of 6 runs passed, middle from a quarter, else hard."""
    return runs.groupBy("repo", "commit").agg(F.count("*").alias("n"), F.count_if("passed").alias("k")).select(
        "repo", "commit", F.when(F.col("k") * 6 >= F.col("n") * 5, "easy").when(F.col("k") * 4 >= F.col("n"), "middle").otherwise("hard").alias("band")
    )


def only_solved_by(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Commits that setup a ever solved and b never did."""
    solved = lambda s: runs.where((F.col("setup") == s) & F.col("passed")).select("repo", "commit").distinct()
    return solved(a).exceptAll(solved(b))


def honesty(runs: DataFrame) -> DataFrame:
    """By setup: runs that said they were done and passed, or failed; that said not done; that said nothing."""
    said = F.col("claimed")
    return runs.groupBy("setup").agg(
        F.count_if((said == "done") & F.col("passed")).alias("done_passed"), F.count_if((said == "done") & ~F.col("passed")).alias("done_failed"), F.count_if(said == "not_done").alias("not_done"), F.count_if(said == "none").alias("no_line")
    )


def selection(tasks: DataFrame, per_repo: int, multi_file: int) -> DataFrame:
    """The first per_repo tasks of each repo by time, at least multi_file of them with several files if there are; in date order.

    tasks: (repo, sha, ts, n_files).
    """
    many = F.col("n_files") > 1
    order = Window.partitionBy("repo").orderBy("ts", "sha")
    ranked = tasks.withColumn("__m", F.when(many, F.sum(many.cast("int")).over(order)))
    quota = ranked.withColumn("__first", F.col("__m").isNotNull() & (F.col("__m") <= multi_file))
    fill = Window.partitionBy("repo").orderBy(F.col("__first").desc(), "ts", "sha")
    return quota.withColumn("__n", F.row_number().over(fill)).where(F.col("__n") <= per_repo).drop("__m", "__first", "__n")


def replaced(repos: DataFrame, qualifying: DataFrame, least: int = 5) -> DataFrame:
    """(slot, repo, used): main repos with fewer qualifying commits than least give their place to the reserves, in order.

    repos: (repo, position, reserve). Reserves that fail as well are passed over; a place without a reserve left is empty.
    """
    n = qualifying.groupBy("repo").agg(F.count("*").alias("n"))
    r = repos.join(n, "repo", "left").withColumn("fine", F.coalesce(F.col("n") >= least, F.lit(False)))
    rank = Window.partitionBy("reserve").orderBy("position")  # a list of repos
    failing = r.where("NOT reserve AND NOT fine").withColumn("k", F.row_number().over(rank)).select("repo", "position", "k")
    spare = r.where("reserve AND fine").withColumn("k", F.row_number().over(rank)).select(F.col("repo").alias("used"), "k")
    kept = r.where("NOT reserve AND fine").select("position", "repo", F.col("repo").alias("used"))
    return kept.unionByName(failing.join(spare, "k", "left").select("position", "repo", "used"))


def manifest(tasks: DataFrame) -> DataFrame:
    """(repo, rule, n): how many candidates the first failing rule skips. tasks: n_tests, n_code, code_lines, words, n_parents."""
    rule = (
        F.when(F.col("n_parents") > 1, "merge").when(F.col("n_tests") == 0, "no tests").when(F.col("n_code") == 0, "no code").when(F.col("code_lines") > 80, "too large").when(F.col("words") < 5, "no description").otherwise("candidate")
    )
    return tasks.groupBy("repo", rule.alias("rule")).agg(F.count("*").alias("n"))


def chain_pairs(tasks: DataFrame) -> DataFrame:
    """Consecutive tasks of a repo two by two: (repo, first_sha, second_sha); an odd last one is left out."""
    w = Window.partitionBy("repo").orderBy("ts", "sha")
    r = tasks.select("repo", F.col("sha").alias("first_sha"), F.lead("sha").over(w).alias("second_sha"), F.row_number().over(w).alias("n"))
    return r.where("n % 2 = 1 AND second_sha IS NOT NULL").drop("n")
