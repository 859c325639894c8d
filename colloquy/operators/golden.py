"""Golden sets over overlapping strata, and agreement with its uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.store import materialise


def valued(calls: DataFrame, key: str, strata: dict[str, Column]) -> DataFrame:
    """(id, each): each row's call, and its (margin, value) in every stratum."""
    each = F.array(*(F.struct(F.lit(name).alias("margin"), c.cast("string").alias("value")) for name, c in strata.items()))
    return calls.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), each.alias("each"))


def spread(rows: DataFrame, repeated: bool) -> DataFrame:
    """``rows`` of ``valued``, once for every stratum that a call has a value in; only calls of several rows can say the same twice."""
    out = rows.select(*(c for c in rows.columns if c != "each"), F.inline("each")).filter("value IS NOT NULL")
    return out.distinct() if repeated else out


def has_repeated(rows: DataFrame) -> bool:
    return not rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty()


def hashed(rows: DataFrame, salt: str = "golden") -> DataFrame:
    """``rows`` with ``h``, which orders calls alike on every run: the first 60 bits of a hash; calls that share them are ordered by id."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return rows.withColumn("h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))


def bottom(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of each margin's value with the smallest hashes; Spark drops the others of a task before it shuffles."""
    w = Window.partitionBy("margin", "value").orderBy("h", "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("rank")


def golden_cover(calls: DataFrame, key: str, strata: dict[str, Column], n: int) -> DataFrame:
    """(id, gain, round): a set of calls in which every value of every stratum has ``n`` calls, or all it has.

    A call counts in all its strata, so calls that fill most come first. Candidates are each value's ``n`` calls of smallest hash, which
    alone could fill it. In each round the calls that fill most unfilled values are ranked by hash within these, and those
    are taken that come within the need of all of them; the first is always among these, so every round takes some.
    Only unfilled values are kept from round to round, a number for each, with a row for each candidate. All is decided in DataFrames,
    whatever the number of values; a call without a key is left out.
    """
    rows = valued(calls, key, strata)
    repeated = has_repeated(rows)
    need = spread(rows, repeated).groupBy("margin", "value").agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("need"))
    need = materialise(need.withColumn("k", F.monotonically_increasing_id()), "golden-need")
    chosen = bottom(spread(hashed(rows), repeated), n).select("id").distinct()
    rows = spread(hashed(rows.join(chosen, "id", "left_semi")), repeated).join(need, ["margin", "value"]).select("id", "h", "k", "need")
    gain = F.count(F.lit(1)).over(Window.partitionBy("id")).cast("int")  # a row for each stratum
    rows, taken = materialise(rows.withColumn("gain", gain), "golden-candidates"), []
    while most := rows.agg(F.max("gain")).first()[0]:
        ranked = rows.filter(F.col("gain") == most).withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("h", "id")))
        now = ranked.groupBy("id").agg(F.bool_and(F.col("rank") <= F.col("need")).alias("fits")).filter("fits")
        now = materialise(now.select("id", F.lit(most).cast("int").alias("gain"), F.lit(len(taken)).alias("round")), "golden-round")
        taken.append(now)
        filled = rows.join(now.select("id"), "id", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("more"))
        rows = rows.drop("gain").join(now.select("id"), "id", "left_anti").join(filled, "k", "left").withColumn("need", F.col("need") - F.coalesce("more", F.lit(0)))
        rows = materialise(rows.filter("need > 0").select("id", "h", "k", "need", gain.alias("gain")), "golden-candidates")
    out = rows.select("id", F.lit(0).alias("gain"), F.lit(0).alias("round")).limit(0)
    for now in taken:
        out = out.unionByName(now)
    return out


def margins_met(calls: DataFrame, key: str, strata: dict[str, Column], n: int, golden: DataFrame) -> DataFrame:
    """(margin, value, available, wanted, met) of a golden set (id)."""
    rows = valued(calls, key, strata)
    picked = golden.select(F.col("id").alias("__picked")).distinct()
    each = spread(rows.join(picked, F.col("id") == F.col("__picked"), "left").withColumn("in", F.col("__picked").isNotNull()).drop("__picked"), has_repeated(rows))
    out = each.groupBy("margin", "value").agg(F.count(F.lit(1)).alias("available"), F.count_if("in").alias("have"))
    wanted = F.least("available", F.lit(n).cast("long"))
    return out.select("margin", "value", "available", wanted.alias("wanted"), (F.col("have") >= wanted).alias("met"))


#: Where the distribution function of Poisson(1) is passed, as shares of 2**32: how often a unit is drawn (fixed values, cut at 8).
POISSON = [1580030169, 3160060337, 3950075422, 4213413783, 4279248374, 4292415292, 4294609778, 4294923276, 4294962463]


def drawn_hash(unit: Column, replicate: Column, salt: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(salt), replicate.cast("string"), unit).cast("binary"))


def times(digest: Column) -> Column:
    """How often the first 32 bits of a digest in lowercase hex draw a unit; digits are compared as they stand, most often once or twice."""
    out = F.when(digest < f"{POISSON[0]:08x}", 0)
    for k, limit in enumerate(POISSON[1:], 1):
        out = out.when(digest < f"{limit:08x}", k)
    return out.otherwise(len(POISSON))


def draws(unit: Column, replicate: Column, salt: str) -> Column:
    """How often a replicate draws a unit: Poisson(1) by hash, so every task and every run draws alike."""
    return times(drawn_hash(unit, replicate, salt))


def alpha(n: Column, s1: Column, s2: Column, d: Column) -> Column:
    """Krippendorff's alpha for interval scores from sums over units: ratings, scores, squared scores, disagreement within units."""
    chance = 2 * (n * s2 - s1 * s1) / F.nullif(n * (n - 1), F.lit(0.0))
    return 1 - (d / F.nullif(n, F.lit(0.0))) / F.nullif(chance, F.lit(0.0))


def agreement_interval(ratings: DataFrame, unit: list[str], score: str, by: list[str], replicates: int = 200, level: float = 0.95, salt: str = "agreement") -> DataFrame:
    """(by, units, ratings, alpha, low, high): agreement of any number of raters, some absent, with a bootstrap interval by units.

    Units with fewer than two scores say nothing of agreement and are left out; so are null scores. Units are drawn
    Poisson(1) times by hash, in one pass over sums that Spark combines before it shuffles; no sample is ever made. Alpha is null where all scores are equal or none is left.
    """
    x = F.col(score).cast("double")
    m, s1, s2 = F.count(x), F.sum(x), F.sum(x * x)
    each = ratings.groupBy(*by, *unit).agg(m.cast("double").alias("m"), s1.alias("s1"), s2.alias("s2")).filter("m >= 2")
    each = each.withColumn("d", 2 * (F.col("m") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("m") - 1))
    key = F.concat_ws("|", *(F.coalesce(F.col(u).cast("string"), F.lit("")) for u in unit))
    drawn = each.withColumn("unit", key).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    drawn = drawn.withColumn("u", drawn_hash(F.col("unit"), F.col("r"), salt))  # a column of its own, so that it is made once
    drawn = drawn.withColumn("w", F.when(F.col("r") == 0, 1).otherwise(times(F.col("u"))).cast("double"))  # replicate 0 is the data
    sums = drawn.groupBy(*by, "r").agg(F.count(F.lit(1)).alias("units"), *(F.sum(F.col("w") * F.col(c)).alias(c) for c in ("m", "s1", "s2", "d")))
    each = sums.select(*by, "r", "units", "m", alpha(F.col("m"), F.col("s1"), F.col("s2"), F.col("d")).alias("alpha"))
    own, others = F.col("r") == 0, F.when(F.col("r") > 0, F.col("alpha"))
    ends = [F.percentile(others, (1 - level) / 2), F.percentile(others, (1 + level) / 2)]
    picked = [F.max(F.when(own, F.col(c))).alias(n) for c, n in (("units", "units"), ("m", "ratings"), ("alpha", "alpha"))]
    return each.groupBy(*by).agg(*picked, ends[0].alias("low"), ends[1].alias("high")).withColumn("ratings", F.col("ratings").cast("long"))
