"""Validation of submitted records as they come: raw JSON, so that fields nobody declared and values of a wrong type are seen.

Texts are parsed once, as VARIANT. Objects' keys are held against closed lists; a value counts only if it has the right type, so a number written as text
is no number. The types of a whole file are told once; heads and runs that are of the declared types throughout are read as structs, all others look by
look, under the same rules. Rules of runs name the places of the runs that break them. A file is looked at within its row, whose size is bounded: nothing is shuffled, and
files alike in hash are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter.operators.trust import ANSWERS, CONTROL, HASH, MAX_BYTES, NAME, OUTCOMES, PRIVATE_TEXT, REPO_ID, REQUEST_BUCKETS, SHA, WEEK, problems

# The fields that an upload, its sides when private, its runs and its versions may have, and the version of the format.
UPLOAD_FIELDS = (
    "usage_upload", "kind", "week", "claim_kind", "task_mode", "public", "repo_id", "versions", "baseline", "challenger", "runs", "verdict", "superseded_attempts", "excluded_commits", "rerun_of", "affiliation",
)
PUBLIC_FIELDS = ("repo",)
SIDE_FIELDS = ("name", "agent", "model")
RUN_FIELDS = ("commit", "setup", "repeat", "outcome", "passed", "model", "agent", "cost_known", "cost_usd", "wall_s", "tokens", "wh", "requests", "tokens_check")
VERSION_FIELDS = ("agentmeter", "factors", "prices", "claude", "codex")
VERSION, VERSION_CHARS, AFFILIATION_CHARS = 1, 40, 100


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Json:
    """Typed looks into a VARIANT column; what isn't of the type asked for is null."""

    def __init__(self, column: Column):
        self.column = column

    def at(self, path: str) -> Column:
        return F.try_variant_get(self.column, f"$.{path}", "variant")

    def kind(self, path: str) -> Column:
        """The type: STRING, BIGINT, DECIMAL..., DOUBLE, BOOLEAN, VOID (JSON's null), ARRAY..., OBJECT...; null where there is nothing."""
        return F.schema_of_variant(self.at(path))

    def absent(self, path: str) -> Column:
        return F.coalesce(self.kind(path) == "VOID", F.lit(True))

    def missing(self, path: str) -> Column:
        """Not even null."""
        return self.kind(path).isNull()

    def is_object(self, path: str) -> Column:
        return self.kind(path).startswith("OBJECT")

    def _value(self, path: str, target: str) -> Column:
        return F.try_variant_get(self.column, f"$.{path}", target)

    def _typed(self, path: str, fits: Column, target: str) -> Column:
        return F.when(fits, self._value(path, target))

    def text(self, path: str) -> Column:
        return self._typed(path, self.kind(path) == "STRING", "string")

    def flag(self, path: str) -> Column:
        return self._typed(path, self.kind(path) == "BOOLEAN", "boolean")

    def count(self, path: str) -> Column:
        """A whole number of at least 0."""
        return _with(self._typed(path, self.kind(path) == "BIGINT", "long"), lambda n: F.when(n >= 0, n))

    def number(self, path: str) -> Column:
        return _with(self._typed(path, self.kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "double"), lambda n: F.when(F.abs(n) < float("inf"), n))

    def numbers(self, path: str, whole: bool) -> Column:
        """An array of numbers, of whole ones of at least 0."""
        each = self._value(path, "array<variant>")
        fits = lambda v: F.schema_of_variant(v).rlike("^BIGINT" if whole else "^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return _with(each, lambda e: F.when(F.forall(e, fits), F.transform(e, lambda v: F.try_variant_get(v, "$", "long" if whole else "double"))))

    def texts(self, path: str) -> Column:
        """An object's values as texts, null for those that are none; null for what is no object."""
        values = F.map_values(F.try_variant_get(self.at(path), "$", "map<string,variant>"))
        return F.transform(values, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))

    def other_keys(self, path: str | None, allowed: tuple[str, ...] | Column) -> Column:
        """An object's keys beyond the allowed ones; null for what is no object."""
        return F.array_except(self._keys(path), allowed if isinstance(allowed, Column) else F.array(*map(F.lit, allowed)))

    def _keys(self, path: str | None) -> Column:
        return F.json_object_keys(F.to_json(self.at(path) if path else self.column))

    def written(self, path: str) -> Column:
        """The value as JSON; empty where there is nothing."""
        plain = _with(self.text(path), lambda t: F.when(t.rlike("^[A-Za-z0-9_.+@-]*$"), F.concat(F.lit('"'), t, F.lit('"'))))  # needs no escapes
        return F.coalesce(F.when(self.kind(path) == "BIGINT", self._value(path, "long").cast("string")), plain, F.to_json(self.at(path)), F.lit(""))


class Fields(Json):
    """The same looks into one of fields(), whose values are taken out and told apart once each."""

    def at(self, path: str) -> Column:
        return self.column["value"][path]

    def kind(self, path: str) -> Column:
        return self.column["kind"][path]

    def _value(self, path: str, target: str) -> Column:
        return F.try_variant_get(self.at(path), "$", target)

    def _keys(self, path: str | None) -> Column:
        return super()._keys(path) if path else self.column["keys"]


def fields(maps: Column, names: tuple[str, ...]) -> Column:
    """An array of maps of VARIANT as structs of their keys and of the named fields' values and types."""
    values = F.transform(maps, lambda m: F.struct(F.map_keys(m).alias("keys"), F.struct(*[F.try_element_at(m, F.lit(n)).alias(n) for n in names]).alias("value")))
    return F.transform(values, lambda x: F.struct(x["keys"].alias("keys"), x["value"].alias("value"), F.struct(*[F.schema_of_variant(x["value"][n]).alias(n) for n in names]).alias("kind")))


class Plain(Json):
    """The same looks into a struct of what is of the declared types throughout, so that nothing is told apart again. Unless strict, there may be other
    keys, which whole, the looks into everything, is asked for."""

    def __init__(self, column: Column, whole: Json | None = None, strict: Column | None = None):
        super().__init__(column)
        self.whole, self.strict = whole, strict

    def at(self, path: str) -> Column:
        found = self.column
        for name in path.split("."):
            found = found[name]
        return found

    def absent(self, path: str) -> Column:
        return self.at(path).isNull()

    missing = absent

    def is_object(self, path: str) -> Column:
        return self.at(path).isNotNull()

    def text(self, path: str) -> Column:
        return self.at(path)

    flag = text

    def count(self, path: str) -> Column:
        n = self.at(path).try_cast("long")  # a private run's commit is a number, but shares its column with hashes
        return F.when(n >= 0, n)

    def number(self, path: str) -> Column:
        return F.when(F.abs(self.at(path)) < float("inf"), self.at(path))

    def numbers(self, path: str, whole: bool) -> Column:
        return self.at(path)

    def texts(self, path: str) -> Column:
        return F.map_values(self.at(path))

    def other_keys(self, path: str | None, allowed: tuple[str, ...] | Column) -> Column:
        none = F.array().cast("array<string>")
        here = none if path is None else F.when(self.is_object(path), none)
        return here if self.whole is None else F.when(self.strict, here).otherwise(self.whole.other_keys(path, allowed))

    def written(self, path: str) -> Column:
        t = self.at(path).cast("string")
        return F.when(t.rlike("^[A-Za-z0-9_.+@-]*$"), t).otherwise(F.to_json(F.struct(t)))  # any text that has no line ends and tells values apart


# What schema_of_variant() says of declared types; it has an object's keys in order, and puts those with other characters in backticks.
_NUMBER, _SOME = r"(?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))", r"[A-Z]+(?:\(\d+,\d+\))?"


def _told(fields: Mapping[str, str], more: str | None = None) -> str:
    """Objects of these fields, each of which may be missing or null; more: and of any others, of that type."""
    known = [f"{name}: (?:{fields[name]}|VOID)" for name in sorted(fields)]
    if more is None:
        return "OBJECT<" + "".join(f"(?:{x}(?:, |(?=>)))?" for x in known) + ">"
    return f"OBJECT<(?:(?:{'|'.join([*known, f'(?!(?:{"|".join(fields)}):)\\w+: {more}'])})(?:, |(?=>)))*>"


def _any(depth: int) -> str:
    """Any type of keys without other characters, nested up to depth."""
    return f"(?:{_SOME}|ARRAY<{_any(depth - 1)}>|OBJECT<(?:\\w+: {_any(depth - 1)}(?:, |(?=>)))*>)" if depth else _SOME


def _head(more: tuple[str | None, str | None] = (None, None)) -> str:
    """Heads, with other keys of these types in them and in the objects that they hold."""
    top, below = more
    side, energy = _told(dict.fromkeys(SIDE_FIELDS, "STRING"), below), _told({"verdict": "STRING"}, below)
    said = dict.fromkeys(("kind", "week", "claim_kind", "task_mode", "repo_id", "rerun_of", "affiliation"), "STRING") | dict.fromkeys(("usage_upload", "superseded_attempts", "excluded_commits"), "BIGINT")
    said |= {"public": "BOOLEAN", "versions": _told(dict.fromkeys(VERSION_FIELDS, "STRING"), below), "baseline": side, "challenger": side, "runs": _any(3)}
    return f"^{_told(said | {'verdict': _told({'answer': 'STRING', 'cost_ratio': _NUMBER, 'energy': energy}, below)}, top)}$"


HEAD_STRUCT = (
    "struct<kind:string,week:string,claim_kind:string,task_mode:string,repo_id:string,rerun_of:string,affiliation:string,usage_upload:bigint,superseded_attempts:bigint,excluded_commits:bigint,public:boolean,"
    "versions:map<string,string>,baseline:struct<name:string>,challenger:struct<name:string>,verdict:struct<answer:string,cost_ratio:double,energy:struct<verdict:string>>>"
)
RUN_STRUCT = (
    "struct<commit:string,setup:string,repeat:bigint,outcome:string,passed:boolean,model:string,agent:string,cost_known:boolean,cost_usd:double,wall_s:double,tokens:array<bigint>,wh:array<double>,requests:string,tokens_check:string>"
)


def _runs(commit: str) -> str:
    """Uploads whose runs are of the declared types, with commits of this one, whatever else they say."""
    run = dict.fromkeys(("setup", "outcome", "model", "agent", "requests", "tokens_check"), "STRING") | {"commit": commit, "repeat": "BIGINT", "passed": "BOOLEAN", "cost_known": "BOOLEAN"}
    run |= {"cost_usd": _NUMBER, "wall_s": _NUMBER, "tokens": "ARRAY<BIGINT>", "wh": f"ARRAY<{_NUMBER}>"}
    return rf"^OBJECT<(?:\w+: {_any(3)}, )*?runs: ARRAY<{_told(run)}>(?:, \w+: {_any(3)})*>$"


STRICT_HEAD, PLAIN_HEAD, PLAIN_RUNS, PRIVATE_RUNS = _head(), _head((_any(2), _any(1))), _runs("STRING"), _runs("BIGINT")


def plain_runs(kinds: Column, public: Column) -> Column:
    """The runs as structs if all are of the declared types; null where one isn't, or a field is missing whose absence differs from null."""
    told = F.when(public, kinds.rlike(PLAIN_RUNS)).otherwise(kinds.rlike(PRIVATE_RUNS))
    there = lambda r: r["commit"].isNotNull() & r["setup"].isNotNull() & r["repeat"].isNotNull() & r["tokens_check"].isNotNull()
    return _with(F.when(told, F.try_variant_get("v", "$.runs", f"array<{RUN_STRUCT}>")), lambda runs: F.when(F.forall(runs, there), runs))


def _no_more(keys: Column) -> Column:
    return F.size(keys) == 0


def file_rules() -> dict[str, Column]:
    """What a file must keep, whatever is in it."""
    c = F.col
    return {"file name isn't the hash": c("file_name") == c("sha256"), "under another submitter": c("author").isNull() | (c("author") == c("submitter"))}


def head_rules(u: Json) -> dict[str, Column]:
    """What an upload's head must keep. An upload that doesn't say public is held to what private ones are."""
    public = F.coalesce(u.flag("public"), F.lit(False))
    allowed = F.concat(F.array(*map(F.lit, UPLOAD_FIELDS)), F.when(public, F.array(*map(F.lit, PUBLIC_FIELDS))).otherwise(F.array().cast("array<string>")))
    rerun, ratio = u.text("rerun_of"), u.number("verdict.cost_ratio")
    # What the text as it came can't hold, what it says doesn't either: a backslash may hide anything, bare control characters below DEL aren't JSON.
    text = F.col("text")
    hidden = F.contains(text, F.lit("\\"))
    odd = hidden | F.contains(text, F.lit("\x7f")) | (F.octet_length(text) != F.length(text))
    private = hidden | F.contains(text, F.lit("http")) | text.rlike("[0-9a-fA-F]{40}")
    says = lambda maybe, what: maybe & F.to_json("v").rlike(what)
    return {
        "public isn't said": u.flag("public").isNotNull(),
        "other fields": _no_more(u.other_keys(None, allowed)),
        "control characters": ~says(odd, CONTROL),
        "private record with address or commit": public | ~says(private, PRIVATE_TEXT),
        "private side's fields": public | (_no_more(u.other_keys("baseline", SIDE_FIELDS)) & _no_more(u.other_keys("challenger", SIDE_FIELDS))),
        "repo_id": F.when(u.absent("repo_id"), public).otherwise(u.text("repo_id").rlike(REPO_ID)),
        "setup name": u.text("baseline.name").rlike(NAME) & u.text("challenger.name").rlike(NAME),
        "week": u.text("week").rlike(WEEK),
        "affiliation": u.absent("affiliation") | (F.length(u.text("affiliation")) <= AFFILIATION_CHARS),
        "rerun_of": u.absent("rerun_of") | (rerun.rlike(HASH) & public),
        "claim or task mode": u.text("claim_kind").isin("agent", "model", "setup") & u.text("task_mode").isin("hint", "tests"),
        "counts": u.count("superseded_attempts").isNotNull() & u.count("excluded_commits").isNotNull(),
        "versions": _no_more(u.other_keys("versions", VERSION_FIELDS)) & F.forall(u.texts("versions"), lambda t: F.coalesce(F.length(t) <= VERSION_CHARS, F.lit(False))),
        "answer": u.text("verdict.answer").isin(*ANSWERS),
        "cost ratio": u.absent("verdict.cost_ratio") | (ratio > 0),
        "energy verdict": u.absent("verdict.energy") | u.text("verdict.energy.verdict").isNotNull(),
    }


def run_rules(r: Json) -> dict[str, Column]:
    """What a run must keep; public, baseline and challenger are its upload's."""
    c = F.col
    four = lambda t: (F.size(t) == 4) & F.forall(t, lambda x: x >= 0)
    ends = lambda w: (F.size(w) == 2) & (F.get(w, F.lit(0)) >= 0) & (F.get(w, F.lit(0)) <= F.get(w, F.lit(1)))
    return {
        "other fields": _no_more(r.other_keys(None, RUN_FIELDS)),
        "unknown outcome": r.text("outcome").isin(*OUTCOMES),
        "passed doesn't match outcome": r.flag("passed") == F.coalesce(r.text("outcome") == "passed", F.lit(False)),
        "setup of neither side": r.text("setup").isin(c("baseline"), c("challenger")),
        "agent or model": r.text("agent").isNotNull() & (r.absent("model") | r.text("model").isNotNull()),
        "bad cost": r.flag("cost_known").isNotNull() & (r.number("cost_usd") >= 0),
        "bad wall time or repeat": (r.number("wall_s") >= 0) & r.count("repeat").isNotNull(),
        "bad tokens": r.absent("tokens") | _with(r.numbers("tokens", True), four),
        "bad energy": r.absent("wh") | _with(r.numbers("wh", False), ends),
        "requests or tokens check": (r.absent("requests") | r.text("requests").isin(*REQUEST_BUCKETS)) & (r.missing("tokens_check") | r.text("tokens_check").isNotNull()),
        "commit isn't of its kind": F.when(c("public"), r.text("commit").rlike(SHA)).otherwise(r.count("commit").isNotNull()),
    }


def _once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """df with a generated column, which filters and projections above don't work out again."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def validate(files: DataFrame) -> DataFrame:
    """(sha256, problems) of uploaded files: every rule that one breaks, in order; rules of runs with the places of these, as 'rule (runs 0, 2)'.

    files: submitter, file_name, sha256, size, text as sources.other_logs.upload_files() gives, and author (null: unknown). A file that is too large, isn't
    JSON, isn't an upload or has no runs is told so and not looked at further. Complete uploads have each commit, both sides and each repeat.
    """
    parsed = _once(_once(files, F.try_parse_json("text"), "v"), F.schema_of_variant("v"), "kinds")
    parsed = _once(parsed, F.col("kinds").rlike(STRICT_HEAD), "strict")
    parsed = _once(parsed, F.when(F.col("strict") | F.col("kinds").rlike(PLAIN_HEAD), F.try_variant_get("v", "$", HEAD_STRUCT)), "plain")

    def both(look: Callable[[Json], Column]) -> Column:
        return F.when(F.col("plain").isNotNull(), look(Plain(F.col("plain"), Json(F.col("v")), F.col("strict")))).otherwise(look(Json(F.col("v"))))

    upload = both(lambda u: F.coalesce((u.count("usage_upload") == VERSION) & (u.text("kind") == "verify"), F.lit(False)))
    sides = both(lambda u: u.is_object("baseline") & u.is_object("challenger"))
    verdict = both(lambda u: u.is_object("verdict") & (u.absent("verdict.energy") | u.is_object("verdict.energy")))
    said = F.struct(both(lambda u: F.coalesce(u.flag("public"), F.lit(False))).alias("public"), both(lambda u: u.text("baseline.name")).alias("baseline"), both(lambda u: u.text("challenger.name")).alias("challenger"))
    parsed = _once(_once(parsed, said, "said"), plain_runs(F.col("kinds"), F.col("said.public")), "plain_runs")
    parsed = _once(parsed, F.when(F.col("plain_runs").isNull(), F.try_variant_get("v", "$.runs", "array<map<string,variant>>")), "runs")
    has_runs = F.coalesce((F.coalesce(F.size("plain_runs"), F.size("runs")) > 0) & (F.col("plain_runs").isNotNull() | F.forall("runs", lambda r: r.isNotNull())), F.lit(False))
    stop = (
        F.when(F.col("size") > MAX_BYTES, "too large").when(F.col("v").isNull(), "not JSON").when(~upload, "not an upload")
        .when(~F.coalesce(sides, F.lit(False)), "sides must be objects").when(~has_runs, "no runs").when(~F.coalesce(verdict, F.lit(False)), "verdict must be an object")
    )
    heads = _once(parsed, stop, "stop")
    of_file = F.when(F.col("stop") == "too large", F.array().cast("array<string>")).otherwise(problems(file_rules()))
    late = F.col("stop").isin("no runs", "sides must be objects", "verdict must be an object")
    first = both(lambda u: problems({k: v for k, v in head_rules(u).items() if k in ("public isn't said", "other fields")}))
    early = F.when(late, first).when(F.col("stop").isNull(), both(lambda u: problems(head_rules(u)))).otherwise(F.array().cast("array<string>"))
    fine = F.col("stop").isNull()
    own = heads.select(
        "sha256", "stop", "said.*", F.concat(of_file, early, F.array_compact(F.array("stop"))).alias("head"),
        F.when(fine, F.col("plain_runs")).alias("plain_runs"), fields(F.when(fine, F.col("runs")), RUN_FIELDS).alias("runs"),
    )

    def looked_at(r: Json) -> Column:
        key = [r.written(name) for name in ("commit", "setup", "repeat")]
        ours = F.coalesce(r.text("setup").isin(F.col("baseline"), F.col("challenger")), F.lit(False))
        return F.struct(problems(run_rules(r)).alias("broken"), key[0].alias("commit"), key[2].alias("repeat"), F.concat_ws("\n", *key).alias("key"), ours.alias("ours"))  # JSON has no line ends

    told = F.when(F.col("plain_runs").isNotNull(), F.transform("plain_runs", lambda run: looked_at(Plain(run)))).otherwise(F.transform("runs", lambda run: looked_at(Fields(run))))
    rows = _once(own, told, "told")
    told = F.col("told")
    broken = F.array_distinct(F.flatten(told["broken"]))
    places = lambda rule: F.filter(F.sequence(F.lit(0), F.size(told) - 1), lambda p: F.array_contains(F.get(told, p)["broken"], rule))
    placed = lambda rule: F.concat(rule, F.lit(" (runs "), F.array_join(F.transform(places(rule), lambda p: p.cast("string")), ", "), F.lit(")"))
    of_runs = F.sort_array(F.transform(broken, placed))
    times = lambda x: F.size(F.array_distinct(x))
    sides_of = F.when(F.col("baseline") == F.col("challenger"), 1).otherwise(2)
    missing = times(told["commit"]) * sides_of * times(told["repeat"]) - times(F.filter(told, lambda r: r["ours"])["key"])
    of_set = F.array_compact(F.array(F.when(times(told["key"]) < F.size(told), "duplicate run"), F.when(missing > 0, "incomplete")))
    return rows.select("sha256", F.concat("head", F.when(F.col("stop").isNull(), F.concat(of_runs, of_set)).otherwise(F.array().cast("array<string>"))).alias("problems"))
