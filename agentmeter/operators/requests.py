"""One row a model request: dedupe, price, energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentmeter.functions.dims import CLASSES, DEFAULT_CLASS, EQUIVALENTS, GRID_G_PER_KWH, KINDS


def ctx_len() -> Column:
    """Tokens of context: everything that goes in."""
    return F.col("fresh_in") + F.col("cache_write") + F.col("cache_read")


def dedupe(raw: DataFrame, key: str = "request_id") -> DataFrame:
    """One row for each request: the largest output, then the earliest, then the first file.

    One shuffle on the key; max_by keeps one row a key on the map side, so copies never travel.
    """
    rest = [c for c in raw.columns if c != key]
    rank = F.struct(F.col("output"), -F.unix_micros("ts"), F.col("file_path"))
    best = raw.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("__r"))
    return best.select(key, "__r.*")


def model_class(model: Column) -> Column:
    """The first class one of whose words is in the name; the default otherwise."""
    name = F.lower(model)
    out = None
    for label, (_, _, words) in CLASSES.items():
        hit = name.contains(words[0])
        for w in words[1:]:
            hit = hit | name.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(DEFAULT_CLASS)


def class_is_assumed(model: Column) -> Column:
    """Whether the name matched no class."""
    words = [w for _, _, ws in CLASSES.values() for w in ws]
    out = F.lit(False)
    for w in words:
        out = out | F.lower(model).contains(w)
    return ~out


def price_for(models: DataFrame, prices: DataFrame) -> DataFrame:
    """models (model, distinct) with the longest price prefix that each name starts with; null columns if there is none.

    Prefixes of a name are cut and joined on equality, so there is no nested loop. Case matters.
    """
    cuts = models.select("model", F.explode(F.sequence(F.lit(1), F.greatest(F.length("model"), F.lit(1)))).alias("n")).select("model", F.expr("substring(model, 1, n)").alias("prefix"))
    found = cuts.join(F.broadcast(prices), "prefix").groupBy("model").agg(F.max_by(F.struct(*prices.columns), F.length("prefix")).alias("p"))
    return models.join(found, "model", "left").select("model", "p.*")


def priced(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """requests with nano_usd, whole nano-dollars; null for a model without a price.

    A prompt whose context is over the long-prompt limit pays the long prices for everything; one-hour writes are at most
    all writes.
    """
    table = price_for(requests.select("model").distinct(), prices)
    r = requests.join(table, "model", "left")
    long_ = F.col("over_tokens").isNotNull() & (ctx_len() > F.col("over_tokens"))
    hour = F.greatest(F.lit(0), F.least(F.col("cache_write_1h"), F.col("cache_write")))
    tokens = {"input": F.col("fresh_in"), "cache_write_5m": F.col("cache_write") - hour, "cache_write_1h": hour, "cache_read": F.col("cache_read"), "output": F.col("output")}
    total = None
    for k in KINDS:
        part = tokens[k] * F.when(long_, F.col(f"lp_{k}")).otherwise(F.col(f"n_{k}"))
        total = part if total is None else total + part
    return r.select(*[F.col(c) for c in requests.columns], total.cast("long").alias("nano_usd"))


def joules(e_pre: Column, e_dec: Column, e_ctx: Column, e_kv: Column) -> Column:
    """Accelerator joules of a request with these coefficients."""
    return (F.col("fresh_in") + F.col("cache_write")) * e_pre + F.col("cache_read") * e_kv + F.col("output") * (e_dec + e_ctx * ctx_len())


def with_energy(requests: DataFrame, ends: DataFrame) -> DataFrame:
    """requests with wh_low and wh_high, watt-hours at the two ends of their class's factors, overhead included."""
    r = requests.withColumn("class", model_class(F.col("model"))).join(F.broadcast(ends), "class", "left")
    wh = lambda e: F.col(f"overhead_{e}") * joules(*[F.col(f"{c}_{e}") for c in ("e_pre", "e_dec", "e_ctx", "e_kv")]) / 3600.0
    return r.select(*[F.col(c) for c in requests.columns], wh("low").alias("wh_low"), wh("high").alias("wh_high"))


def measured(requests: DataFrame, prices: DataFrame, ends: DataFrame) -> DataFrame:
    return with_energy(priced(requests, prices), ends)


#: What W is made of, in the order of e_pre, e_kv, e_dec and e_ctx.
SUMS = ("pre", "kv", "dec", "ctx")


def token_sums(requests: DataFrame, by: list[str]) -> DataFrame:
    """By group and class the sums of tokens that joules() multiplies with a coefficient each. They are whole numbers and the same for every corner."""
    parts = (F.col("fresh_in") + F.col("cache_write"), F.col("cache_read"), F.col("output"), F.col("output") * ctx_len())
    r = requests.select(*by, model_class(F.col("model")).alias("class"), *[x.alias(n) for n, x in zip(SUMS, parts, strict=True)])
    return r.groupBy(*by, "class").agg(*[F.sum(n).alias(n) for n in SUMS])


def weighted_tokens(requests: DataFrame, corners: DataFrame, by: list[str]) -> DataFrame:
    """W for each group and corner: joules over the joules of a prefilled token, so that only ratios matter.

    Tokens are summed before they meet the corners, so that no request is shuffled once a corner.
    """
    r = token_sums(requests, by).join(F.broadcast(corners), "class")
    w = sum((F.col(n) * F.col(f"e_{n}") for n in SUMS[1:]), F.col("pre") * F.col("e_pre")) / F.col("e_pre")
    return r.select(*by, "class", "corner", w.alias("w"))


def everyday(df: DataFrame) -> DataFrame:
    """df (wh_low, wh_high) with grams of CO2 and counts of everyday things, each low and high."""
    for end in ("low", "high"):
        df = df.withColumn(f"co2_g_{end}", F.col(f"wh_{end}") / 1000 * GRID_G_PER_KWH)
        for item, each in EQUIVALENTS.items():
            df = df.withColumn(f"{item}_{end}", F.col(f"wh_{end}") / each)
    return df


def count_label(x: Column) -> Column:
    """A count in words: under one, tenths below two, whole below 100, tens below 1000, hundreds above; halves go to even."""
    tenth = F.regexp_replace(F.format_number(F.bround(x, 1), 1), r"\.0$", "")
    return (
        F.when(x < 1, "<1").when(x < 2, tenth).when(x < 100, F.format_number(F.bround(x, 0), 0)).when(x < 1000, F.format_number(F.bround(x / 10, 0) * 10, 0))
        .otherwise(F.format_number(F.bround(x / 100, 0) * 100, 0))
    )
