"""Comparison of runs, calibrated rewards and agreement of raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stihora.functions import numeric as N


def run_means(scored: DataFrame, run: str, metrics: list[str]) -> DataFrame:
    """Means of the metrics by run; nulls are skipped."""
    return scored.groupBy(run).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))


def two_views(scored: DataFrame, run: str, key: list[str], metrics: list[str], paired_runs: list[str]) -> DataFrame:
    """Means over all rows, and over the keys that all of some runs have, in one table with `view`."""
    wanted = scored.filter(F.col(run).isin(paired_runs))
    shared = wanted.groupBy(*key).agg(F.countDistinct(run).alias("_n")).filter(F.col("_n") == len(paired_runs)).select(*key)
    every = run_means(scored, run, metrics).withColumn("view", F.lit("all"))
    return every.unionByName(run_means(wanted.join(shared, key, "left_semi"), run, metrics).withColumn("view", F.lit("paired")))


def identification(scored: DataFrame, target: str, predicted: str, run: str, metrics: list[str]) -> DataFrame:
    """Means by target and run, and the share of the run's rows predicted as the target."""
    size = scored.groupBy(run).agg(F.count("*").alias("_size"))
    taken = scored.groupBy(run, F.col(predicted).alias(target)).agg(F.count("*").alias("_taken"))
    means = scored.groupBy(target, run).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))
    out = means.join(size, run).join(taken, [target, run], "left")
    return out.withColumn("share_predicted", F.coalesce("_taken", F.lit(0)) / F.col("_size")).drop("_size", "_taken")


def masked(df: DataFrame, condition: Column, *cols: str) -> DataFrame:
    """Some columns null where a condition holds, as for scores that would leak."""
    return df.withColumns({c: F.when(condition, F.lit(None)).otherwise(F.col(c)) for c in cols})


def calibration(features: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """(group, feature, n, mean, std, corpus_std) with population deviations."""
    long = features.unpivot([group], cols, "feature", "value")
    corpus = long.groupBy("feature").agg(F.stddev_pop("value").alias("corpus_std"))
    return long.groupBy(group, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).join(F.broadcast(corpus), "feature")


def hit_percentile(hits: DataFrame, group: str, col: str, q: float, floor: float) -> DataFrame:
    """A percentile by group, at least the floor."""
    return hits.groupBy(group).agg(F.greatest(N.percentile(F.col(col), q), F.lit(floor)).alias("p"))


def leave_one_out(bags: DataFrame, group: str, key: str, item: str) -> DataFrame:
    """(group, key, cosine) of each bag (key, item, n) with the sum of its group's other bags.

    The others' counts are the group's less the bag's own, where positive; the
    squares over all items come from the group's total and a correction for
    the bag's items, so no bag meets the items it lacks.
    """
    total = bags.groupBy(group, item).agg(F.sum("n").alias("all"))
    square = total.groupBy(group).agg(F.sum(F.col("all") * F.col("all")).alias("sq"))
    joined = bags.join(total, [group, item]).withColumn("rest", F.col("all") - F.col("n"))
    parts = joined.groupBy(group, key).agg(F.sum(F.col("n") * F.col("rest")).alias("inner"), F.sum(F.col("n") * F.col("n")).alias("own"), F.sum(F.col("all") * F.col("all") - F.col("rest") * F.col("rest")).alias("less"))
    out = parts.join(square, group)
    length = F.sqrt(F.col("own").cast("double")) * F.sqrt((F.col("sq") - F.col("less")).cast("double"))
    return out.select(group, key, F.when(length > 0, F.col("inner") / length).otherwise(0.0).alias("cosine"))


def nearest_rank(df: DataFrame, col: str, qs: dict[str, float], limits: dict[str, int]) -> DataFrame:
    """One row of nearest-rank quantiles and counts above limits.

    Values are counted before they are ranked, so what is ranked grows with
    the different values only.
    """
    n = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c"))
    ranked = n.withColumns({"upto": F.sum("c").over(Window.orderBy("v")), "total": F.sum("c").over(Window.partitionBy())})
    at = lambda q: F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total")))
    return ranked.agg(
        F.max("total").alias("n"), F.max("v").alias("largest"), *(F.min(F.when(F.col("upto") > at(q), F.col("v"))).alias(k) for k, q in qs.items()),
        *(F.coalesce(F.sum(F.when(F.col("v") > x, F.col("c"))), F.lit(0)).alias(k) for k, x in limits.items()),
    )


def spread(df: DataFrame, group: str, col: str) -> DataFrame:
    """Mean, mean deviation within groups, deviation between the groups' means."""
    by = df.groupBy(group).agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s"))
    return df.agg(F.avg(col).alias("mean")).join(by.agg(F.avg("s").alias("within_std"), F.stddev_pop("m").alias("between_std")))


def interval_alpha(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """Krippendorff's alpha for interval data over units with two ratings or more; NaN with fewer than two, 1 without variation.

    The squared differences of all pairs of a unit are 2 * (n * sum(x*x) -
    sum(x)**2), so no pairs are made.
    """
    x = F.col(value).cast("double")
    units = ratings.filter(x.isNotNull()).groupBy(unit).agg(F.count("*").alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).filter("m > 1")
    t = units.agg(F.count("*").alias("units"), F.sum("m").alias("n"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("within"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    observed = F.col("within") / F.col("n")
    expected = 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return t.select(F.col("units").alias("n_units"), F.when(F.col("units") < 2, F.lit(float("nan"))).when(expected == 0, 1.0).otherwise(1 - observed / expected).alias("alpha"))


def bootstrap_interval(df: DataFrame, col: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """(mean, low, high) of the mean by resampling, with draws by hash.

    Every row gets a Poisson weight in each draw, which is resampling without
    gathering the rows: the weighted sums of a draw are ordinary aggregates.
    Equal rows are numbered, so that each has its own weights.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("_row"), F.col("draw")), F.lit(1_000_003)) + 0.5) / 1_000_003
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    rows = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"), F.xxhash64(*df.columns).alias("_row"))
    rows = rows.groupBy("x", "_row").agg(F.count("*").alias("_n")).select("x", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("_k"), "_row").select("x", F.xxhash64("_row", "_k").alias("_row"))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    means = drawn.groupBy("draw").agg((F.sum(F.col("x") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    ordered = F.sort_array(F.collect_list("m"))
    ends = means.agg(F.element_at(ordered, int(0.025 * draws) + 1).alias("low"), F.element_at(ordered, int(0.975 * draws)).alias("high"))
    return rows.agg(F.avg("x").alias("mean")).join(ends)


def two_level_means(ratings: DataFrame, system: str, item: str, scale: str, value: str) -> DataFrame:
    """Means of items first, then of systems and scales."""
    items = ratings.groupBy(system, item, scale).agg(F.avg(value).alias("m"))
    return items.groupBy(system, scale).agg(F.count("*").alias("n_items"), F.avg("m").alias("mean"))


def largest_export(exports: DataFrame, key: list[str], size: str, order: str) -> DataFrame:
    """Of several exports with one key, the one with most entries; the first of equal ones."""
    rest = [c for c in exports.columns if c not in key]
    return exports.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct((-F.col(size)).alias("a"), F.col(order).alias("b"))).alias("_one")).select(*key, "_one.*")


def tier_shares(df: DataFrame, tier: str) -> DataFrame:
    return df.groupBy(tier).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def reward(df: DataFrame, alpha: float = 1.0, beta: float = 1.0, power: float = 3.0) -> DataFrame:
    """total = alpha * valid * unique * style + beta * valid * novelty ** power * content."""
    valid = F.col("cyrillic") * F.col("no_chat") * F.col("nonempty")
    return df.withColumns({
        "valid": valid, "reward_style": alpha * valid * F.col("line_uniqueness") * F.col("style"), "reward_content": beta * valid * F.pow(F.col("novelty"), F.lit(power)) * F.col("content"),
    }).withColumn("reward", F.col("reward_style") + F.col("reward_content"))


def errors_of(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with the names of the rules that each row breaks; a whole batch is checked before any of it is applied."""
    return df.withColumn("errors", F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull()))


def within_budget(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Rows that fit a token budget; longer ones are dropped whole, never cut."""
    return df.filter(tokens <= most)


def smallest_fitting(lengths: DataFrame, col: str, limits: list[int]) -> DataFrame:
    """The smallest limit that no length exceeds; null if all are exceeded."""
    longest = lengths.agg(F.max(col).alias("longest"))
    return longest.select("longest", F.array_min(F.filter(F.array(*map(F.lit, limits)), lambda x: x >= F.col("longest"))).alias("limit"))


#: The groups of style features and their weights.
STYLE_GROUPS = {"pos": 1.0, "diversity": 1.0, "line": 1.0, "stanza": 1.0, "bigrams": 1.0, "rhymes": 0.5, "words": 0.5}


def style_composite(df: DataFrame, groups: dict[str, list[str]], weights: dict[str, float] | None = None) -> DataFrame:
    """df with `style`: the weighted mean of the groups' means; columns that are null do not count in theirs."""
    w = weights or STYLE_GROUPS
    total = sum(w[g] for g in groups)
    means = {g: F.coalesce(N.mean_of_known(*map(F.col, cols)), F.lit(0.0)) for g, cols in groups.items()}
    return df.withColumn("style", sum((w[g] * m for g, m in means.items()), F.lit(0.0)) / total)


def gates(df: DataFrame) -> DataFrame:
    """df with the gates validity, uniqueness and novelty."""
    return df.withColumns({"gate_valid": F.col("cyrillic") * F.col("no_chat") * F.col("nonempty"), "gate_unique": F.col("line_uniqueness"), "gate_novel": F.col("novelty")})


def expectations(scored: DataFrame, case: str, kind: str, score: str, better: list[tuple[str, str]]) -> DataFrame:
    """(case, better, worse, holds): whether one kind of candidate scores above another in each case."""
    wide = scored.groupBy(case).agg(F.map_from_entries(F.collect_list(F.struct(kind, score))).alias("_s"))
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("better"), F.lit(b).alias("worse")) for a, b in better)))
    asked = wide.select(case, "_s", pairs.alias("_p")).select(case, "_p.better", "_p.worse", F.try_element_at("_s", F.col("_p.better")).alias("_a"), F.try_element_at("_s", F.col("_p.worse")).alias("_b"))
    return asked.filter("_a is not null and _b is not null").select(case, "better", "worse", (F.col("_a") > F.col("_b")).alias("holds"))
